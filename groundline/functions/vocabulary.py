"""Word lists and patterns that results depend on."""

# Abbreviations that do not end a sentence.
ABBREVIATIONS = """inc. corp. ltd. co. llc. plc. u.s. u.k. e.g. i.e. vs. approx. no. fig. dr. mr. ms. st.
jan. feb. mar. apr. jun. jul. aug. sep. sept. oct. nov. dec.""".split()

# Words without retrieval signal.
STOPWORDS = """a an and are as at be been but by for from has have had he her his if in into is it its of on or she that the
their them there these they this to was were what when where which who will with would you your our we us""".split()

# Irregular words and their stems.
IRREGULAR = {
    "was": "be", "were": "be", "is": "be", "are": "be", "been": "be", "has": "have", "had": "have", "having": "have", "does": "do", "did": "do", "done": "do",
    "data": "datum", "criteria": "criterion", "phenomena": "phenomenon", "bacteria": "bacterium", "indices": "index", "matrices": "matrix", "media": "medium",
    "analyses": "analysis", "bases": "basis", "crises": "crisis", "diagnoses": "diagnosis", "hypotheses": "hypothesis", "theses": "thesis", "prognoses": "prognosis",
    "parentheses": "parenthesis", "syntheses": "synthesis", "metastases": "metastasis", "anastomoses": "anastomosis",
}

# Patterns of tokens, sentence ends, citation markers.
TOKEN = r"[a-z0-9]+(?:[.'-][a-z0-9]+)*"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z(\"'0-9])"
MARKER = r"\[(\d+)\]"

# Routing vocabularies (stemmed where they are used).
FINANCIAL = """revenue income earnings ebitda margin profit loss eps dividend cash flow debt leverage covenant assets liabilities
capex expenditure guidance filing quarter fiscal segment shareholders chargeback""".split()
BIOMEDICAL = """patients trial cohort randomised randomized placebo efficacy dose therapy clinical endpoint mortality diagnosis
prevalence incidence sensitivity specificity biomarker gene protein vaccine treatment disease enrolled""".split()

# Patterns of years, periods, comparisons, names and joined questions in a query.
YEAR = r"\b(?:19|20)\d{2}\b"
FISCAL = r"(?i)\b(?:fy|fiscal(?:\s+year)?)\s*\d{2,4}\b"
COMPARISON = r"(?i)\b(?:compare|compared|comparison|versus|vs\.?|against|between|difference|changed?\s+(?:from|between)|relative\s+to)\b"
NAME = r"\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z.]+)+"
JOINED = r"(?i)\s+and\s+(?=(?:what|how|why|which|who|when|does|did|is|are|was|were)\b)"

# Patterns of page furniture.
PAGE_LINE = r"(?im)^\s*(?:page\s+\d+(?:\s+of\s+\d+)?|\d+\s*\|\s*page|-\s*\d+\s*-)\s*$"
CONTENTS_LINE = r"(?im)^\s*table of contents\s*$"
COPYRIGHT_LINE = r"(?im)^\s*(?:©|\(c\))\s*\d{4}.*$"
DOT_LEADER = r"\.{4,}\s*\d*"
PUNCTUATION_RUN = r"([^\w\s])\1{3,}"

# Patterns of metadata in a document's first characters.
FISCAL_YEAR = r"(?i)fiscal year (?:ended|ending)[^.]{0,40}?((?:19|20)\d{2})"
FORM_TYPE = r"(?i)\bform\s+(10-K|10-Q|8-K|20-F|S-1)\b"
CIK = r"(?i)central index key[^0-9]{0,20}(\d{4,10})"
HEADING = r"^(#{1,4})\s+(.+?)\s*#*$"
ITEM = r"^\s*item\s+(\d{1,2}[ab]?)\s*[.:\-–]?\s*(.{0,120}?)\s*$"
ITEM_TITLES = {
    "1": "Business", "1A": "Risk Factors", "1B": "Unresolved Staff Comments", "2": "Properties", "3": "Legal Proceedings", "5": "Market for Registrant's Common Equity",
    "7": "Management's Discussion and Analysis", "7A": "Quantitative and Qualitative Disclosures About Market Risk", "8": "Financial Statements and Supplementary Data", "9A": "Controls and Procedures",
}

# Fixed value: the answer given without evidence.
NO_EVIDENCE = "The indexed corpus does not contain evidence that answers this question."
#: White space of every script, for regular expressions of Java and RE2 alike.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
SOLID = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
