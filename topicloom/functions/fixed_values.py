"""Values that results depend on, kept as plain data."""

# Whitespace as Python's str.strip and \s see it.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = r"\s\x0B\x1C-\x1F\x85\p{Z}"

# Characters the corpus cleaner turns into a space, the bracket it
# turns into a full stop, and the two phrases it deletes afterwards.
CORPUS_PUNCTUATION = ",ㆍ·'\"’‘”“!?|<>`[◇…"
CORPUS_FULL_STOP = "]"
CORPUS_PHRASES = ("a href AJAX class link onclick javascript fncLawPop", "prec")

# Fixed value: characters the record cleaner keeps besides whitespace.
RECORD_KEEP = ".,%:()가-힣0-9"

# Sentence ends of the corpus split and the shortest kept piece.
CORPUS_SENTENCE_ENDS = r"[./?\n]"
CORPUS_LONGER_THAN = 20

# Section markers of a judgment text for the sentence corpus.
CORPUS_SECTIONS = (
    "【주    문】(.+?)【이    유】",
    "【이    유】(.+?)(주심)",
)

# Section markers of a judgment text for the nested records, first
# match wins: (pattern, text appended to the match, characters cut off its end).
RULING_RULES = (
    ("【주    문】(.+?)【이    유】", "", 0),
    ("【주  문】(.+?)【이  유】", "", 0),
    ("【주    문】(.+?)【이  유】", "", 0),
    ("[주    문](.+?)[이    유]", "", 0),
    ("【주문】(.+?)【이유】", "", 0),
)
REASONING_RULES = (
    ("【이    유】(.+?) 주문과 같이 판결한다.", " 주문과 같이 판결한다.", 0),
    ("【이    유】(.+?) 주문과 같이 결정한다.", " 주문과 같이 결정한다.", 0),
    ("【이    유】(.+?)(재판장)", "", 8),
    ("【이  유】(.+?)(재판장)", "", 8),
    ("[이    유](.+?) 주문과 같이 판결한다.", " 주문과 같이 판결한다.", 0),
    ("[이    유](.+?) 주문과 같이 결정한다.", " 주문과 같이 결정한다.", 0),
    ("【이  유】(.+?) 이를 기각한다.", " 이를 기각한다.", 0),
    ("【이유】(.+?)", "", 0),
    ("【이  유】(.+?)", "", 0),
    ("【이    유】(.+?)", "", 0),
)
SHORTEST_FULL_TEXT = 100

# Class numbers of the inference labels, and the top of the similarity scale.
INFERENCE_LABELS = {"contradiction": 0, "entailment": 1, "neutral": 2}
SIMILARITY_SCALE = 5.0

# Cells a CSV reader of the pandas kind takes for null.
CSV_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Settings of the published runs.
BLEND_WEIGHT = 0.25
MERGE_PAGE = 20000
MERGE_KEEP = 2
