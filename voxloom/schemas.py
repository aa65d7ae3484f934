"""Table layouts and the fixed names this library agrees on with its users."""

from pyspark.sql import types as T

CATALOG_SCHEMA = T.StructType([
    T.StructField("subset", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("iso", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("clips", T.LongType()),
    T.StructField("hours", T.DoubleType()),
    T.StructField("train", T.LongType()),
    T.StructField("val", T.LongType()),
    T.StructField("test", T.LongType()),
])
CATALOG_COLUMNS = CATALOG_SCHEMA.names

# Columns a built clip table carries besides the standard ones: the place of its
# language in the selection, the clip's own key and its split.
INTERNAL_COLUMNS = ["position", "clip_id", "split"]

# Written beside decoded audio: how many samples a channel of it has.
SAMPLE_COUNT = "audio_samples"

SPLITS = ("train", "val", "test", "all")

# ---------------------------------------------------------------------------
# Fixed values. These must stay as they are for results to be right.
# ---------------------------------------------------------------------------

# The standard clip table, in output order.
STANDARD_COLUMNS = ["audio", "text", "language", "country", "length", "iso", "subset"]

# Source names accepted for the transcript and for the duration; the first one present is used.
TEXT_NAMES = [
    "text", "sentence", "transcript", "transcription", "transcription_text",
    "normalized_text", "normalised_text", "translation",
]
DURATION_NAMES = ["length", "duration", "duration_seconds", "audio_length"]

# Stored split names that count as each split.
SPLIT_ALIASES = {
    "train": ["train"],
    "val": ["val", "validation", "dev"],
    "test": ["test"],
}

# Column layouts of common training frameworks: output column -> standard column.
TRAINING_SCHEMAS = {
    "default": None,
    "asr": {"audio": "audio", "text": "text"},
    "whisper": {"audio": "audio", "sentence": "text"},
    "common_voice": {
        "audio": "audio", "sentence": "text", "language": "language",
        "country": "country", "length": "length",
    },
}

# Text-to-speech manifest layouts and the name each one's manifest goes by.
MANIFEST_FILES = {
    "ljspeech": "metadata.csv",
    "piper": "metadata.csv",
    "vits": "filelist.txt",
    "melo": "metadata.list",
}
SPEAKER_FILE = "speakers.txt"

# ISO 3166-1 alpha-2 codes of the countries covered, with display names.
COUNTRY_NAMES = {
    "AO": "Angola",
    "BF": "Burkina Faso",
    "BI": "Burundi",
    "BJ": "Benin",
    "CD": "DR Congo",
    "CF": "Central African Republic",
    "CG": "Congo",
    "CI": "Côte d'Ivoire",
    "CM": "Cameroon",
    "CV": "Cabo Verde",
    "DZ": "Algeria",
    "ET": "Ethiopia",
    "GH": "Ghana",
    "GQ": "Equatorial Guinea",
    "GW": "Guinea-Bissau",
    "KE": "Kenya",
    "LR": "Liberia",
    "MG": "Madagascar",
    "MU": "Mauritius",
    "MW": "Malawi",
    "MZ": "Mozambique",
    "NA": "Namibia",
    "NG": "Nigeria",
    "RE": "Réunion",
    "RW": "Rwanda",
    "SC": "Seychelles",
    "SL": "Sierra Leone",
    "SN": "Senegal",
    "SS": "South Sudan",
    "TG": "Togo",
    "TZ": "Tanzania",
    "UG": "Uganda",
    "ZA": "South Africa",
    "ZM": "Zambia",
    "ZW": "Zimbabwe",
}

# Every character Python's str.strip() removes.
STRIP_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A decimal digit of any script.
DIGIT_PATTERN = r"\p{Nd}"
