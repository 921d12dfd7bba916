"""Values that results depend on. All are fixed: ranking, floors and text handling change with any of them."""

# Words that carry no topic.
STOPWORDS = """
a about above after again against all also am an and any are as at be because been before being below between both but
by can cannot could did do does doing down during each either else enough etc for from further had has have having he
her here hers herself him himself his how however i if in into is it its itself just may me might more most must my
myself neither no nor not now of off on once only or other others ought our ours ourselves out over own rather same
shall she should since so some such than that the their theirs them themselves then there therefore these they this
those through to too under until up very was we were what when where whether which while who whom whose why will with
within would you your yours
""".split()

# Words that ask for the same concept.
SYNONYM_GROUPS = [
    line.split()
    for line in """
deadline due date cutoff submit submission deliverable delivery milestone schedule completion final last
author written creator created developer developed publisher owner organisation organization manufacturer
purpose objective aim goal intent mission rationale
problem issue risk limitation shortcoming weakness constraint challenge threat
result outcome finding performance metric capability accuracy
component part subsystem module element assembly feature
cost price budget expense funding
method approach technique procedure process methodology
requirement specification criterion criteria standard
user operator personnel crew analyst engineer staff
location place site region area country station
speed rate velocity throughput latency frequency
size dimension length width height weight capacity
test trial exercise evaluation validation assessment verification
""".strip().splitlines()
]
MAX_ADDED = 24

# The feature-hashing embedder.
DIMENSIONS, EMBEDDER = 2048, "hashing-v1"
WORD_WEIGHT, PAIR_WEIGHT, THREE_WEIGHT, FOUR_WEIGHT = 1.0, 1.4, 0.1, 0.1

# BM25, coordination, headings and fusion.
K1, B, COORDINATION = 1.2, 0.75, 0.2
RRF, VECTOR_FLOOR, LEXICAL_FLOOR, VECTOR_POOL = 60, 0.14, 0.01, 200
HEADING_WEIGHT, HEADING_ADMITS, HEADING_COMMON, HEADING_CHARS = 2.5, 0.7, 0.35, 120

# Passages and snippets, in characters.
PASSAGE_TARGET, PASSAGE_MOST, PASSAGE_LEAST, PASSAGE_OVERLAP, PASSAGE_SHORTEST = 1100, 1700, 150, 180, 40
SNIPPET, SNIPPET_LEAD = 260, 70

# Limits of requests and stored rows.
QUERY_CHARS, ASK_CHARS, HITS, MOST_HITS, SEARCH_HITS = 500, 2000, 6, 20, 8
DOCUMENT_CHARS, PAGE_CHARS, ERROR_CHARS, NAME_CHARS, FILE_BYTES = 3_000_000, 400_000, 500, 200, 15 * 1024 * 1024
SUMMARY_CHARS, COMPARISON_CHARS = 60_000, 26_000
TRANSCRIPT, MOST_TRANSCRIPT, HISTORY, MOST_HISTORY, HISTORY_CHARS, MESSAGE_CHARS = 100, 200, 6, 20, 400, 2000

# Answers that have a meaning of their own.
NOT_FOUND = "I couldn't find this information in the uploaded document."
NOT_SPECIFIED = "Not specified in the document."
CATEGORIES = ["Main Objective", "Technologies", "Key Findings", "Limitations"]

# What users are told of files, pages, questions, models and comparisons.
NO_FILE = "No file selected. Choose a PDF and try again."
NOT_PDF = " is not a PDF. Only PDF files are supported."
EMPTY_FILE = " is empty (0 bytes)."
LARGE_FILE = " MB. The maximum upload size is 15 MB."
LOCKED_PDF = "This PDF is password-protected. Remove the password and try again."
BROKEN_PDF = "This PDF could not be read. The file appears to be corrupted."
CANCELLED_PDF = "Reading the PDF was cancelled."
UNREAD_PDF = "This PDF could not be read. It may be corrupted or incomplete."
NO_TEXT = "No extractable text was found in this PDF."
TOO_LONG = "This document exceeds the processing limit."
NO_PASSAGES = "No usable passages were found in this PDF."
FRIENDLY = ["No extractable text", "processing limit", "no pages"]
SIGN_IN = "Sign in to search documents."
SHORT_QUERY = "Enter a search query of at least two characters."
SELECT_ONE = "Select at least one document to search."
EMPTY_RESPONSE = "The AI model returned an empty response."
TIMED_OUT = "The AI request timed out. Please try again."
RATE_LIMITED = "The AI service is rate limited right now. Please try again shortly."
UNAVAILABLE = "The configured AI model is unavailable ("
AI_FAILED = "AI request failed: "
NO_OBJECT = "The model did not return a structured comparison."
MALFORMED = "The model returned malformed comparison JSON."
NO_ROWS = "The comparison response was missing its rows."
NO_USABLE = "The comparison response contained no usable rows."

# What shows that another attempt would fail in the same way.
NO_ACCESS = "api.?key|unauthori[sz]ed|forbidden|401|403"

#: White space in every pattern, for Java's and RE2's syntax alike: what trimming removes, no-break spaces included.
SPACE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
