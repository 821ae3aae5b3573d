"""Fixed values. They define the label scheme, the patterns and the formats, so
results depend on them literally; everything else in the package is parameters."""

# --- label scheme -----------------------------------------------------------
LABELS = ("positive", "neutral", "negative")

# Words and numbers accepted as labels out of the box.
WORD_LABELS = {
    "positive": "positive",
    "pos": "positive",
    "bullish": "positive",
    "1": "positive",
    "neutral": "neutral",
    "neu": "neutral",
    "mixed": "neutral",
    "0": "neutral",
    "negative": "negative",
    "neg": "negative",
    "bearish": "negative",
    "-1": "negative",
}

# The integer-coded corpus uses its own, different coding.
CODED_LABELS = {0: "negative", 1: "positive", 2: "neutral"}

# --- null tokens of the CSV dialect -----------------------------------------
CSV_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- whitespace: every character Python's str.isspace() accepts --------------
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java regex class body.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# --- patterns (Java regex) ---------------------------------------------------
WORD = r"\p{L}\p{N}_"  # word characters, Unicode-aware
URL = rf"https?://[^{WS}]+|www\.[^{WS}]+"
SPACE_RUN = rf"[{WS}]{{2,}}"
TICKER = r"\$[A-Za-z][A-Za-z.\-]*"
NUMBER = rf"(?<![{WORD}])\p{{Nd}}+(?:[.,]\p{{Nd}}+)?(?![{WORD}])"
PERCENT = rf"(?<![{WORD}])\p{{Nd}}+(?:[.,]\p{{Nd}}+)?[{WS}]*%"
PLUS_BEFORE_BYTE = r"\+(?=[\x80-\xff])"
DOUBLE_PLUS = r"\+\+(?=[A-Za-z])"
REPLACEMENT_CHAR = "\ufffd"
RIGHT_QUOTE = "\u2019"
COUNT_TOKEN = r"[A-Za-z]+(?:'[A-Za-z]+)?"
LEXICON_TOKEN = r"[A-Za-z][A-Za-z'-]*"
FEATURE_TOKEN = rf"[{WORD}]{{2,}}"
ASCII_FEATURE_TOKEN = r"[A-Za-z0-9_]{2,}"

# --- metrics -----------------------------------------------------------------
METRICS = (
    "accuracy", "macro_f1", "weighted_f1", "macro_precision",
    "weighted_precision", "macro_recall", "weighted_recall",
)

METRIC_NAMES = {
    "accuracy": "Accuracy",
    "macro_f1": "Macro-F1",
    "weighted_f1": "Weighted-F1",
}

# Names of the curves in tables of training logs.
LOSS_NAMES = {"loss": "Train Loss", "eval_loss": "Eval Loss"}
EVAL_METRIC_NAMES = {
    "eval_accuracy": "Eval Accuracy",
    "eval_macro_f1": "Eval Macro-F1",
    "eval_weighted_f1": "Eval Weighted-F1",
}

# Columns of the run manifest, in order.
MANIFEST = (
    "run_name", "model", "train_domain", "eval_name", "eval_domain", "eval_split", "setting",
    "accuracy", "macro_f1", "weighted_f1",
    "metrics_path", "prediction_path", "confusion_matrix_path", "confusion_figure_path",
)

# --- models ------------------------------------------------------------------
MODEL_TYPES = ("logreg", "linear_svm", "naive_bayes")
LEXICON_MODEL = "lm_lexicon_rule"

# --- fixed-length encoding: special ids, then vocabulary ids ------------------
PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = 0, 1, 2, 3, 4
FIRST_WORD_ID = 5
IGNORED_TARGET = -100
