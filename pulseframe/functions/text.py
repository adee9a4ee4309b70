"""Column functions and row generators on document text."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .arrays import let

# Chunk length, overlap and the length up to which a text is kept whole.
CHUNK_SIZE, CHUNK_OVERLAP, MAX_CHUNK_CHARS = 512, 64, 1024

# Tag -> keywords.
TAG_KEYWORDS = {
    "quantizacao": ["quantizacao", "INT8", "PTQ", "QAT", "zero_point", "quantization"],
    "firmware": ["firmware", "STM32", "TFLM", "CMSIS-NN", "bare-metal", "Cortex-M4"],
    "dsp": ["filtro", "Butterworth", "AMPT", "R-peak", "filtfilt", "bandpass", "notch"],
    "ml": ["GroupKFold", "F1-macro", "backbone", "fine-tuning", "AAMI", "inter-patient"],
    "lgpd": ["LGPD", "PII", "anonimizacao", "consentimento", "dados pessoais"],
    "devops": ["uv", "Docker", "CI/CD", "pre-commit", "DVC", "Makefile"],
    "energia": ["energia", "mJ", "mAh", "Renode", "autonomia", "consumo"],
    "dados": ["MIT-BIH", "Chapman", "PhysioNet", "dataset", "download", "resample"],
    "modelagem": ["CNN", "1D-CNN", "softmax", "sigmoid", "backbone", "pre-treino"],
    "seguranca": ["JWT", "OAuth2", "Argon2", "bcrypt", "hash", "CSP", "XSS"],
}
# Part of a file name -> layer, first match wins.
LAYERS = {
    "Camada-01": "C01", "Camada-02": "C02", "Camada-03": "C03", "Camada-04": "C04", "Camada-05": "C05",
    "Camada-06": "C06", "Camada-07": "C07", "Camada-08": "C08", "Camada-09": "C09", "Camada-10": "C10",
    "SDD_": "SDD", "PRD": "PRD", "UNIFIED": "UNIFIED", "ESPECIFICACAO": "ESPECIFICACAO", "SIMULATION": "SIMULATION", "DEBITO": "DEBITO_TECNICO",
}
# Personal data (national ids, e-mail, name in a clinical context).
PII_PATTERNS = [
    r"(?i)\b\d{3}\.\d{3}\.\d{3}-\d{2}\b",
    r"(?i)\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b",
    r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    r"(?i)\b(?:paciente|patient|nome|name):\s*\w+",
]
# Raw-signal files and folders that are never indexed.
FORBIDDEN_EXTENSIONS = ["dat", "mat", "hea", "atr", "xyz", "ecg"]
FORBIDDEN_FOLDERS = ["raw_chapman/", "raw_mitbih/", "raw_svdb/", "raw_afdb/", "raw_incart/", "raw_ptbxl/"]


def is_forbidden(path: Column) -> Column:
    """P10."""
    pattern = r"(\.(" + "|".join(FORBIDDEN_EXTENSIONS) + r")$)|" + "|".join(FORBIDDEN_FOLDERS)
    return F.lower(path).rlike(pattern)


def layer(name: Column) -> Column:
    """P11."""
    return F.coalesce(*[F.when(name.contains(k), v) for k, v in LAYERS.items()], F.lit("GENERAL"))


def version(name: Column) -> Column:
    """P11."""
    v = F.regexp_extract(name, r"v(\d+\.\d+)", 1)
    return F.when(v != "", F.concat(F.lit("v"), v)).otherwise("unversioned")


def tags(text: Column) -> Column:
    """Sorted tags whose keywords occur, case ignored; the text is lowered once."""
    def found(low: Column) -> Column:
        out = []
        for tag in sorted(TAG_KEYWORDS):
            hit = F.lit(False)
            for k in TAG_KEYWORDS[tag]:
                hit = hit | low.contains(k.lower())
            out.append(F.when(hit, tag))
        return F.array_compact(F.array(*out))

    return let(F.lower(text), found)


# A text without this character cannot match the pattern at the same place above.
_PII_NEEDS = ["-", "/", "@", ":"]


def pii(text: Column) -> Column:
    """All matches of personal data; patterns run only where their fixed character occurs."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(text.contains(c), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for p, c in zip(PII_PATTERNS, _PII_NEEDS)])


def front_matter(text: Column) -> Column:
    """Map of the leading key: value block; empty when there is none."""
    block = F.regexp_extract(text, r"(?s)^---(.*?)---", 1)
    lines = F.filter(F.split(F.trim(block), "\n"), lambda v: v.contains(":"))
    pairs = F.transform(lines, lambda v: F.struct(F.trim(F.substring_index(v, ":", 1)).alias("k"), F.trim(F.regexp_replace(v, r"^[^:]*:", "")).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["k"] != ""))


METADATA_KEYS = ["experiment_id", "run_id", "stage", "status", "health_status", "tags"]


def metadata(source: Column, text: Column) -> Column:
    """Fields of `- **key:** value` bullets; the stage falls back to the file name."""
    def field(k: str) -> Column:
        v = F.trim(F.regexp_extract(text, r"(?m)^\s*- \*\*" + k + r":\*\*(.*)$", 1))
        return F.when(v != "", v)

    stem = F.regexp_extract(source, r"([^/]*?)(\.[^./]*)?$", 1)
    first = F.substring_index(stem, "_", 1)
    vals = {k: field(k) for k in METADATA_KEYS}
    vals["stage"] = F.coalesce(vals["stage"], F.when(first.startswith("stage"), first))
    vals["tags"] = F.filter(F.transform(F.split(F.coalesce(vals["tags"], F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")
    return F.struct(*[v.alias(k) for k, v in vals.items()])


def chunk_id(source: Column, text: Column) -> Column:
    """First 16 hex digits of the hash of source and content."""
    return F.substring(F.sha2(F.concat(source, F.lit(":"), text), 256), 1, 16)


# Places to cut at, the first that makes the pieces short enough wins: paragraph, line, sentence, word.
SEPARATORS = ["\n\n", "\n", ". ", " "]
_BLANK = " \t\n\r"


def _cut_at(sep: str, size: int):
    def kept(parts: Column) -> Column:  # all but the last were followed by the separator
        return F.concat(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.concat(p, F.lit(sep))), F.slice(parts, -1, 1))

    def cut(a: Column) -> Column:
        parts = let(F.split(a, sep.replace(".", "[.]")), kept)
        return F.when(F.length(a) <= size, F.array(a)).otherwise(F.filter(parts, lambda p: p != ""))

    return cut


def pieces(text: Column, size: int) -> Column:
    """The text as consecutive pieces of at most `size` characters; only a word longer than that is cut.

    Pieces that are too long go down the ladder of separators; a separator stays with the piece before it.
    """
    def slices(a: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.length(a) - 1) / size).cast("int"))
        return F.when(F.length(a) <= size, F.array(a)).otherwise(F.transform(at, lambda i: F.substring(a, i * size + 1, F.lit(size))))

    got = F.array(text)
    for sep in SEPARATORS:
        got = F.flatten(F.transform(got, _cut_at(sep, size)))
    return F.flatten(F.transform(got, slices))


def _tail(t: Column, n: Column) -> Column:
    """The last n characters of t at most, from the beginning of a word."""
    r = F.right(t, n)
    whole = (F.length(t) <= n) | F.substring(t, F.length(t) - n, F.lit(1)).isin(*_BLANK)
    return F.when(n <= 0, "").when(whole, r).otherwise(F.regexp_replace(r, f"^[^{_BLANK}]+", ""))


def chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Pieces merged greedily into chunks of at most `size` characters, trimmed, empty ones left out.

    A chunk begins with the last whole words of the one before, `overlap` characters at most and as many as fit.
    """
    def put(s: Column, a: Column) -> Column:
        full = (s["cur"] != "") & (F.length(s["cur"]) + F.length(a) > size)
        room = F.least(F.lit(overlap), F.lit(size) - F.length(a))
        cut = F.struct(F.concat(s["out"], F.array(s["cur"])).alias("out"), F.concat(_tail(s["cur"], room), a).alias("cur"))
        return F.when(full, cut).otherwise(F.struct(s["out"].alias("out"), F.concat(s["cur"], a).alias("cur")))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    done = lambda s: F.transform(F.concat(s["out"], F.array(s["cur"])), lambda c: F.btrim(c, F.lit(_BLANK)))
    return F.filter(F.aggregate(pieces(text, size), start, put, done), lambda c: c != "")


def chunk(df: DataFrame, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, keep_whole: int | Column = 0, part: str = "part", count: str = "n_parts") -> DataFrame:
    """One row per chunk, numbered from 0, with the number of chunks of its text; texts up to `keep_whole` characters stay whole. A null or blank text has none."""
    t = F.col(text)
    whole = keep_whole if isinstance(keep_whole, Column) else F.lit(keep_whole)
    alone = F.filter(F.array(F.btrim(t, F.lit(_BLANK))), lambda c: c != "")
    x = df.withColumn("_chunks", F.when(F.length(t) <= whole, alone).otherwise(chunks(t, size, overlap)))
    return x.select(*df.columns, F.size("_chunks").alias(count), F.posexplode("_chunks").alias(part, "content"))


def strip_html(text: Column) -> Column:
    """P17."""
    return F.regexp_replace(text, "<[^>]*>", "")


def words(text: Column) -> Column:
    """Lower-case word tokens."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def clean_query(text: Column) -> Column:
    """Punctuation and operators removed, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def overlap_tokens(text: Column) -> Column:
    """Token set of the retrieval evaluator: words without surrounding dots and commas."""
    raw = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s.,]", " "), r"\s+")
    bare = F.transform(raw, lambda t: F.regexp_replace(t, r"^[.,]+|[.,]+$", ""))
    return F.array_distinct(F.filter(bare, lambda t: t != ""))


def _cut_sections(level: int):
    """Each section (body and the headers above) as its subsections of the next level."""
    mark = "#" * level + " "

    def cut(s: Column) -> Column:
        above = [s[f"header_{i}"].alias(f"header_{i}") for i in range(1, level)]

        def one(p: Column, i: Column) -> Column:
            headed = (i > 0) | F.ltrim(p).startswith("#" if level == 1 else mark)
            rest = F.when(F.instr(p, "\n") > 0, F.regexp_replace(p, r"^[^\n]*\n", "")).otherwise("")
            head = F.trim(F.regexp_replace(F.substring_index(p, "\n", 1), r"^[# ]+", ""))
            return F.struct(F.when(headed, rest).otherwise(p).alias("body"), *above, F.when(headed, head).alias(f"header_{level}"))

        return F.transform(F.split(s["body"], "\n" + mark), one)

    return cut


def split_markdown(df: DataFrame, text: str, depth: int = 1) -> DataFrame:
    """One row per section with its header path `header_1` .. `header_<depth>`, in the order of `section`.

    A text is cut at top headers; what comes before the first one has none. With a depth of 2 or more every section is
    cut further at headers of the next level, and carries the headers above it on.
    """
    s = F.array(F.struct(F.col(text).alias("body")))
    for level in range(1, depth + 1):
        s = F.flatten(F.transform(s, _cut_sections(level)))
    x = df.select("*", F.posexplode(s).alias("section", "_s"))
    return x.select(*df.columns, "section", *[f"_s.header_{i}" for i in range(1, depth + 1)], "_s.body")


SUMMARY_FOLDER = "data/lineage/experiments/"


def documents(df: DataFrame, source: str, text: str) -> DataFrame:
    """Every text as the sections that are to be chunked: columns section, header_1, body, is_summary, and keep_whole.

    Experiment summaries stay in one piece under their first line, if that is a header; markdown is cut at its top headers; other files are code, one
    section without a header, of which nothing is kept whole.
    """
    t, path = F.col(text), F.col(source)
    x = df.withColumns({"is_summary": path.contains(SUMMARY_FOLDER) & path.endswith(".md"), "keep_whole": F.when(path.endswith(".md"), MAX_CHUNK_CHARS).otherwise(0)})
    cut = split_markdown(x.filter(path.endswith(".md") & ~path.contains(SUMMARY_FOLDER)), text)
    head = F.when(F.col("is_summary") & t.startswith("# "), F.trim(F.regexp_replace(F.substring_index(t, "\n", 1), "^[# ]+", "")))
    one = x.filter(~(path.endswith(".md") & ~path.contains(SUMMARY_FOLDER))).select("*", F.lit(0).alias("section"), head.alias("header_1"), t.alias("body"))
    return cut.unionByName(one)


def part_header(part: Column, count: Column) -> Column:
    """`parte_n` on the chunks of a text that has several."""
    return F.when(count > 1, F.concat(F.lit("parte_"), (part + 1).cast("string")))


# ---- stemming ---------------------------------------------------------------------------

def _measure(s: str) -> int:
    forms = "".join("v" if c in "aeiou" or (c == "y" and i and s[i - 1] not in "aeiou") else "c" for i, c in enumerate(s))
    return sum(1 for a, b in zip(forms, forms[1:]) if a == "v" and b == "c")


def _has_vowel(s: str) -> bool:
    return any(c in "aeiou" or (c == "y" and i and s[i - 1] not in "aeiou") for i, c in enumerate(s))


def _cvc(s: str) -> bool:
    if len(s) < 3:
        return False
    v = lambda i: s[i] in "aeiou" or (s[i] == "y" and i and s[i - 1] not in "aeiou")
    n = len(s)
    return not v(n - 3) and v(n - 2) and not v(n - 1) and s[-1] not in "wxy"


# Suffix rules of the published Porter algorithm.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
          ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
          ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


@lru_cache(maxsize=200_000)
def porter(w: str) -> str:
    """Stem of one lower-case word (published Porter algorithm)."""
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suf in ("ed", "ing"):
            if w.endswith(suf) and _has_vowel(w[: -len(suf)]):
                w = w[: -len(suf)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for suf, rep in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(suf):
                if _measure(w[: -len(suf)]) > 0:
                    w = w[: -len(suf)] + rep
                break
    for suf in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suf):
            base = w[: -len(suf)]
            if _measure(base) > 1 and (suf != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stem(tokens: pd.Series) -> pd.Series:
    """Stems of a token column; each distinct token of a batch is stemmed once."""
    codes, uniq = pd.factorize(tokens)
    stems = pd.Series([porter(u) for u in uniq], dtype="object")
    return stems.take(codes).reset_index(drop=True)
