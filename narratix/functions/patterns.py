"""Patterns in the subset that Java and RE2 read alike: no \\w, \\b, \\s or \\d, and no lookaround."""

SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same signs but the space, one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
STRIP = rf"\A{SPACE}+|{SPACE}+\z"
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
TOKEN = rf"[^{SPACE[1:-1]}]+"
MEANINGFUL = "[A-Za-z]{3,}"
LETTER = r"\p{L}"

# Abbreviations whose stops do not end a sentence.
ABBREVIATIONS = ("Fig.", "Dr.", "Mr.", "Ms.", "Prof.", "e.g.", "i.e.", "etc.")
STOP, CUT = "\x02", "\x01"
SENTENCE = rf"([.!?]){SPACE}+([A-Z0-9\"'])"

YEAR = "(?:1[5-9][0-9]{2}|20[0-9]{2})"
YEARS = rf"{YEAR}(?:{SPACE}+{YEAR})"
DEBRIS = r"[=\-–—_\[\](){}.,;:" + SPACE[1:-1] + "]+"
NUMERIC = r"[0-9.,;:()\-–—" + SPACE[1:-1] + "]+"
SECTION = r"[0-9]+(?:\.[0-9]+)"
#: Markers of the layout and the speech rules: bounds on years, sections and length differ.
LAYOUT_MARKER = rf"\A(?:[0-9]{{1,3}}|{YEARS}{{0,3}}|{SECTION}{{1,3}}(?:{SPACE}+{YEAR}){{1,4}})\z"
SPEECH_MARKER = rf"\A(?:[0-9]{{1,3}}|{YEARS}{{0,4}}|{SECTION}{{1,3}}(?:{SPACE}+{YEAR}){{1,5}})\z"
#: Markers of the cleaner and the narration rules, and their test of what is left of digits and stops.
CLEAN_MARKER = rf"\A(?:[0-9]{{1,3}}|(?:[0-9]{SPACE}*){{1,4}}|{YEAR}|{SECTION}+(?:{SPACE}+{YEAR})+|{YEARS}+|{DEBRIS})\z"
SHORT_KEY = rf"\A(?:[0-9]{{1,3}}\.?|{YEAR})\z"
SECTION_KEY = rf"\A{SECTION}+(?:\.?{YEAR})*\z"

CHAPTER_LABEL = rf"(?i)\Achapter{SPACE}+[0-9]+{SPACE}*:"
SENTENCE_END = r"[.!?]['\")\]]?\z"

PAGE_NUMBER = r"\A[0-9]+\z"
ARTIFACT = r"\A[0-9.,\-–—" + SPACE[1:-1] + r"]+\z"
URL = r"(?i)(?:https?://|www\.)"
DOI = r"(?i)(?:(?:\A|[^\p{L}\p{N}_])doi(?:[^\p{L}\p{N}_]|\z)|10\.[0-9]{4,9}/)"
PUBLISHER = "springer nature|switzerland ag"
CAPTION = rf"(?i)\A(?:figure|fig\.|table){SPACE}+[0-9]+"

# Signs of a publisher's line, particles of names, words that titles leave small.
NOISE = r"isbn|doi|copyright|©|all rights reserved|springer|palgrave|routledge|press|published|www\.|http|library of congress|catalog|printed|edition|volume"
NOISE_ONLY = r"\A[0-9\-–—:.,/" + SPACE[1:-1] + r"]+\z"
PARTICLES = ("de", "del", "da", "dos", "van", "von", "der", "la", "le", "y")
SMALL = ("and", "or", "of", "the", "a", "an", "to", "in", "for", "with", "by")
BY = rf"(?i)\A(?:by|edited by|written by){SPACE}+"
LATIN_WORD = r"[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ'-]*"

# What a refined summary must not hold. B is the edge of a word, L the start and E the end of a line.
B, L, E = r"(?:\A|\z|[^\p{L}\p{N}_])", rf"(?:\A|\n){SPACE}*", rf"{SPACE}*(?:\n|\z)"
BANNED = (
    f"(?i){L}title{SPACE}*:",
    f"(?i){L}introduction{E}",
    f"(?i){L}conclusion{E}",
    f"(?i){L}references{E}",
    f"(?i){L}bibliography{E}",
    f"(?i){L}examples{E}",
    f"(?i){L}key themes?{E}",
    f"(?i){L}key questions?{SPACE}*:",
    f"(?i){L}key question{SPACE}*:",
    f"(?i){L}recommendations?{E}",
    f"(?i){L}next steps{E}",
    f"(?i){L}note{SPACE}*:",
    f"(?i){B}this paper{B}",
    f"(?i){B}this work{B}",
    f"(?i){B}structured framework{B}",
    f"(?i){B}critical synthesis{B}",
    f"(?i){B}would you like{B}",
    f"(?i){B}let me know{B}",
    rf"(?i){B}doi\.org{B}",
    rf"(?i){B}et al\.",
    rf"\([A-Z][A-Za-z-]+,{SPACE}*[0-9]{{4}}[a-z]?\)",
)
HEADING_LABELS = ("executive summary", "quick summary", "detailed summary", "book review", "overview", "summary", "central argument", "key takeaway", "final takeaway", "conclusion", "final thoughts")
