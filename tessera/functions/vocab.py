"""Word lists, patterns and lookup tables. All are defaults; every function takes its own."""

from __future__ import annotations

# The terms, patterns, lists and names that results depend on.
TERMS = """
    carbon emission ghg co2 climate renewable biodiversity waste deforestation reforestation greenhouse solar environmental sustainability
    sustainable decarbonization decarbonize offset recycle recyclable diversity stakeholder esg csr materiality tcfd gri sasb sfdr csrd sbti sdg
""".split()
EXTRA_PATTERNS = [
    r"sustainab\w+",
    r"decarboni\w+",
    r"recycl\w+",
    r"offset\w+",
    r"co2e?",
    r"scope\s*[123]",
    r"scope\s+(?:one|two|three)",
    r"water\s+(?:usage|consumption|stewardship|management)",
    r"social\s+(?:responsibility|impact|policy|pillar|report|performance|value|welfare|audit|capital|sustainability|license)",
    r"energy\s+(?:consumption|efficiency|transition|mix)",
    r"human[\s\-]rights?",
    r"net[\s\-]zero",
    r"circular\s+economy",
    r"paris\s+agreement",
    r"health\s+and\s+safety",
    r"employee\s+well\w*",
    r"supply[\s\-]chain\s+(?:ethics|risk)",
    r"responsible\s+(?:sourcing|investment|business)",
    r"double\s+materiality",
    r"transition\s+plan",
    r"renewable\s+energy",
    r"wind\s+(?:power|energy)",
    r"tonne\w*\s+(?:co2|carbon)",
    r"science[\s\-]based\s+targets?",
    r"un\s+sdg",
]
STOP_WORDS = """
    aaa ab abengoa abide abif abn aboukhair abovementioned abroad abrupt abs absence absent absorb absorbing absorbs absorption academic academy
    accenture accept acceptance accepting accepts accessed according accordingly acerinox achieve achieved across acs addition additional
    additionally address adidas adidasag adj aena af ag ah ai airbus airliquide aj aktg aktiengesetz aktionrsrechterichtlinie al allianz almirall
    alvarez am amadeus america annette apple arcelormittal argentina arug as asmls at au av avangrid axa axas banco bangladesh bankia banking
    bankinter basf bazin bbva benoit benz bmw bmwgroup bnp bnpparibas boston botin brian brngger bundesanzeiger caixabank cambodia campari carlsberg
    daniel danone deloitte deutsche dominique dow enel engie fifa forbes frankfurt frdric french galan germany germanys gobain goldman grupo
    handelsgesetzbuch hedge herv herzogenaurach hgb huerta iberdrola iberdrola ignacio inditex ing javier jose kere kpmg kpmgag kpmgs linkou loral
    manuel mercede mercedes mercedesbenz myanmar nanterre nathalie naturgy nestl nokia palao paribas paris pascal pernod peugeot philippe pierre
    pricewaterhousecooper pwc repsol ricard roger russia sachs safran saint saintgobain sanchez santander santanders sarbanesoxley schneider statista
    stephan tainan telefonica totalenergie traetubolsa tran tttt unaffected undetectable unfold vallecana veldhoven verona vietnam vincent violeta
    vivid vppa webapp websitewwwcnmves wilton wwwiberdrolacom xavier zara
""".split()
TOPIC_STOP_WORDS = """
    gmbh ltd spa nv plc ag inc corp sa document registration universal statutory supervisory chairman remuneration appendix appendice caption
    recognise recognize fiscal shall programme program nancial tion ment mot prev eurm eur eurm dec abp unicredit intesa sanpaolo nordea nordeas bnpp
    adyen abinbev inbev ambev volkswagen daimler ferrari stellantis ergo eni enis infineon siemens siemen semiconductor sap telekom tmobile lvmh
    kering herm maison hennessy vuitton essilorluxottica essilor ahold delhaize vincis concession brse clearstream eurex qimonda france french german
    dutch netherlands spain spanish italy italian austria vienna
""".split()
COUNTRY_ALIASES = {
    "ALEMANIA": "GERMANY",
    "BELGICA": "BELGIUM",
    "ESPAÑA": "SPAIN",
    "FINLANDIA": "FINLAND",
    "FRANCIA": "FRANCE",
    "ITALIA": "ITALY",
    "PAISES BAJOS": "NETHERLANDS",
}
COMPANY_ALIASES = {
    "BBVA": "BCO BILBAO VIZCAYA ARGENTARIA",
    "BANCO SANTANDER S A": "BCO SANTANDER",
    "IBERDROLA S A": "IBERDROLA",
    "INDITEX": "INDUSTRIA DE DISENO TEXTIL SA",
    "BMW GROUP": "BMW",
    "DEUTSCHE BORSE": "DEUTSCHE BOERSE",
    "DEUTSCHE POST AG DHL": "DEUTSCHE POST",
    "DEUTSCHE TELEKOM AG": "DEUTSCHE TELEKOM",
    "INFINEON TECHNOLOGIES AG": "INFINEON TECHNOLOGIES",
    "MERCEDES BENZ GROUP AG ANTIGUO DAIMLER": "MERCEDES BENZ GROUP",
    "MUNICH RE AG": "MUENCHENER RUECK",
    "SAP SE": "SAP",
    "SIEMENS AG": "SIEMENS",
    "VOLKSWAGEN AG VZ": "VOLKSWAGEN PREF",
    "AXA S A": "AXA",
    "AIRBUS SE": "AIRBUS",
    "BNP PARIBAS S A": "BNP PARIBAS",
    "COMPAGNIE DE SAINT GOBAIN S A": "SAINT GOBAIN",
    "HERMES INTERNATIONAL S A": "HERMES INTERNATIONAL",
    "KERING S A": "KERING",
    "L OREAL S A": "L OREAL",
    "LVMH SA": "LVMH MOET HENNESSY",
    "PERNOD RICARD S A": "PERNOD RICARD",
    "SANOFI AVENTIS S A": "SANOFI",
    "SANOFI AVENTIS SA": "SANOFI",
    "TOTAL S A": "TOTALENERGIES",
    "VINCI S A": "VINCI",
    "ENI SPA": "ENI",
    "FERRARI NV": "FERRARI",
    "INTESA SANPAOLO S P A": "INTESA SANPAOLO",
    "INTESA SANPAOLO SPA": "INTESA SANPAOLO",
    "UNICREDIT SPA O UNICREDIT GROUP": "UNICREDIT",
    "UNICREDIT GROUP": "UNICREDIT",
    "AHOLD DELHAIZE KON EO 01": "AHOLD DELHAIZE",
    "ASML HOLDING NV": "ASML HLDG",
    "GRUPO ING NV": "ING GRP",
    "STELLANTIS NV": "STELLANTIS",
    "WOLTERS KLUWER NV": "WOLTERS KLUWER",
}
QUANT_PATTERNS = {
    "percentages": r"\b\d+(?:[.,]\d+)?\s*%",
    "large_numbers": r"\b\d{4,}\b",
    "units": r"\b(?:tonne|ton|mt|ktco2|co2e?|ghg|kwh|mwh|gwh|twh|mw|gw|litre|liter|m3|cubic meter)\b",
    "frameworks": r"\b(?:gri|tcfd|sasb|issb|sdg|ungc|sfdr|csrd|un global compact|paris agreement|taxonomy)\b",
}
HEDGE_CATEGORIES = ["Uncertainty", "WeakModal", "StrongModal", "Constraining"]
W_QUANT, W_HEDGE = 0.5, 0.5
KW_THRESHOLD, CONTEXT, LEAST_ZONE = 1.0, 1, 150
HEADER_BAND, FOOTER_BAND, RUNNING_SHARE, RUNNING_CHARS = 0.08, 0.92, 0.30, 120
# Labels of an index over 0 and of the others.
FLAGGED, GENUINE = "Flagged", "Not flagged"
TOPIC_COUNTS, TOPIC_ALPHAS, TOPIC_RUNS = (8, 12, 16, 20, 24), ("auto",), 5
# Column headers of the result files.
CORPUS_COLUMNS = {"document": "Documento", "country": "País", "company": "Compañía", "year": "Año", "doc_type": "TipoDocumento", "clean_text": "clean_text"}
RESULT_COLUMNS = {"document": "Documento", "country": "País", "company": "Compañía", "year": "Año", "doc_type": "TipoDocumento", "sus": "SUS_Score", "sen": "SEN_Score", "quant": "QUANT_Score", "hedge": "HEDGE_Score", "idx": "Index", "idx_ext": "Index_ext", "label": "Etiqueta", "label_ext": "Etiqueta_ext"}
COHERENCE_COLUMNS = {"num_topics": "Num_topics", "alpha": "Alpha", "iter": "Iter", "c_v": "C_v", "u_mass": "U_mass", "c_npmi": "C_npmi"}
