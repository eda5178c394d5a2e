"""Languages, character maps and thresholds that results depend on."""

# fixed values: (language, text code, speech-model tag, manifest code, low resource)
LANGUAGES = (
    ("English", "eng", "eng_Latn", "eng", False),
    ("Hindi", "hin", "hin_Deva", "hin", False),
    ("Urdu", "urd-script_arabic", "urd_Arab", "urd", False),
    ("Assamese", "asm", "asm_Beng", "asm", False),
    ("Bengali", "ben", "ben_Beng", "ben", False),
    ("Marathi", "mar", "mar_Deva", "mar", False),
    ("Tamil", "tam", "tam_Taml", "tam", False),
    ("Telugu", "tel", "tel_Telu", "tel", False),
    ("Kannada", "kan", "kan_Knda", "kan", False),
    ("Malayalam", "mal", "mal_Mlym", "mal", False),
    ("Punjabi", "pan", "pan_Guru", "pan", False),
    ("Manipuri", "ben", "ben_Beng", "mani", True),
    ("Gujarathi", "guj", "guj_Gujr", "guj", False),
    ("Odia", "ory", "ory_Orya", "ory", False),
    ("Bodo", "asm", "asm_Beng", "brx", True),
    ("Chattisgarhi", "hin", "hin_Deva", "hne", True),
    ("Dogri", "hin", "hin_Deva", "doi", True),
    ("Garo", "eng", "eng_Latn", "grt", True),
    ("Galo", "eng", "eng_Latn", "adl", True),
    ("Jaintia", "eng", "eng_Latn", "aml", True),
    ("Kashmiri", "urd-script_arabic", "urd_Arab", "kas", True),
    ("Khasi", "eng", "eng_Latn", "kha", True),
    ("Kokborok", "ben", "ben_Beng", "xtr", True),
    ("Konkani", "hin", "hin_Deva", "kok", True),
    ("Ladakhi", "eng", "eng_Latn", "lbj", True),
    ("Lepcha", "eng", "eng_Latn", "lep", True),
    ("Maithili", "hin", "hin_Deva", "mai_Deva", True),
    ("Mizo", "eng", "eng_Latn", "lus", True),
    ("Nepali", "hin", "hin_Deva", "nep", True),
    ("Purgi", "urd-script_arabic", "urd_Arab", "prx", True),
    ("Sanskrit", "hin", "hin_Deva", "san", True),
    ("Santhali", "ben", "ben_Beng", "sat_Beng", True),
    ("Sargujia", "hin", "hin_Deva", "sgj", True),
    ("Sikkimese", "eng", "eng_Latn", "sip", True),
    ("Sindhi", "hin", "hin_Deva", "snd_Deva", True),
)

# fixed values: the forced aligner's codes by text code, and those of single languages
ALIGNER_CODES = {
    "eng": "bd", "hin": "hi", "urd-script_arabic": "ur", "asm": "as", "ben": "bn", "mar": "mr", "tam": "ta", "tel": "te", "kan": "kn",
    "mal": "ml", "pan": "pa", "guj": "gu", "ory": "or", "English": "en", "Manipuri": "mni",
}

# fixed values: Unicode blocks of the scripts
SCRIPTS = {
    "Deva": "\\u0900-\\u097F",
    "Beng": "\\u0980-\\u09FF",
    "Taml": "\\u0B80-\\u0BFF",
    "Telu": "\\u0C00-\\u0C7F",
    "Knda": "\\u0C80-\\u0CFF",
    "Mlym": "\\u0D00-\\u0D7F",
    "Guru": "\\u0A00-\\u0A7F",
    "Gujr": "\\u0A80-\\u0AFF",
    "Orya": "\\u0B00-\\u0B7F",
    "Arab": "\\u0600-\\u06FF\\u0750-\\u077F",
    "Latn": "A-Za-z",
}

# fixed values: punctuation, Arabic and Indic character maps (left to right, one to one, then deletions)
PUNCTUATION = ("“”‘’—–•·", "\"\"''--..")
ELLIPSIS, TATWEEL = "…", "ـ"
ARABIC = ("ىةۀأإآ", "يههااا")
HARAKAT = "ًٌٍَُِّْ"
NUKTA = ("ड़", "ड"), ("ढ़", "ढ")
CHANDRABINDU, ANUSVARA = "ँ", "ं"
ZERO_WIDTH = "[\\u200B-\\u200D\\uFEFF]"
INDIC_CODES = ("hin", "mar", "tam", "tel", "kan", "mal", "pan", "guj", "ory")

# fixed values: Bengali and Assamese letters and vowel signs in the cleanup rules
BENGALI_BASE = "অ-হয়ৰৱ"
BENGALI_SIGNS = "ািীুূৃেৈোৌ"
BENGALI_VOWELS = "া-ৌেো"

# fixed values: sentence boundaries; '!' is none; the ranges around them let most characters pass at one look
BOUNDARY = "[?~.|\\n\\r\\t[\\u0600-\\u2E7F&&[[\\u0600-\\u07FF&&[؟܀۔]][\\u0900-\\u097F&&[।॥]]።[\\u2000-\\u2E7F&&[⁇⁈⁉‼⸮⸼…—]]]]]"

# fixed values: span widths (inclusive ranges) and alignment thresholds
SPAN_RANGES = ((1, 4), (4, 6), (6, 10), (10, 18), (18, 25))
MIN_SPAN_CHARS, TOLERANCE_WORDS = 3, 15
OVERRIDE_FUSED, OVERRIDE_SINGLE = 0.75, 0.5
FUSE = (0.45, 0.55)
FUSED_MIN_LOW, FUSED_MIN = 0.45, 0.55
SHORTLIST_LOW, SHORTLIST, SHORTLIST_SINGLE = 75, 25, 60
THRESHOLD_LOW, THRESHOLD, THRESHOLD_FALLBACK = 0.45, 0.65, 0.55
DISPLAY_BAND, OVERRIDE_MARGIN = 0.5, 0.10

# fixed values: dataset split
MIN_ROWS, VALID_SHARE, TEST_ROWS, HIGH_QUANTILE = 1000, 0.05, 500, 0.90
SEED_VALID, SEED_TOP_UP, SEED_TEST = 42, 43, 24

# fixed values: file name patterns of the merge job
SHEET_PATTERNS = (
    "*_aligned.xlsx",
    "*_sliding_aligned.xlsx",
    "*_aligned_topk_only.xlsx",
    "*_all_pairs_before_threshold.xlsx",
    "*_aligned_both_candidates.xlsx",
)
TOP_SHEETS = (
    "all_aligned.xlsx",
    "all_aligned_without_null.xlsx",
    "all_all_candidates.xlsx",
    "all_all_candidates_without_null.xlsx",
)
