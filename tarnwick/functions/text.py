"""Text functions as Catalyst expressions: all stay inside generated code, none calls Python."""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() sees it in ASCII text; Spark's trim() takes spaces only.
_SPACE = r"[ \t\n\r\f\x0b]"
#: A word border that Java and RE2 read alike, also beside letters outside ASCII.
_L, _R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"

# Words that routing never counts as topics.
STOP_WORDS = (
    "the and for with that this from into when where what how why which then than onto will shall have has had using used use user users your "
    "their there here also only more most many much each other does doesnt dont should must can could would"
).split()
COMMON_TOPICS = "overview introduction general notes guide docs doc readme example examples reference misc common default".split()
# English words that a search query drops.
QUERY_STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can to of in on at by for with about "
    "as into from and but or not so than too very it its i me my we our you your he she they him her his them their there here this that these "
    "those what which who how when where use used using"
).split()
# Phrases by question type; a name's score is the number of its phrases that occur.
QUESTION_TYPES = {
    "setup": ["install", "setup", "prerequisite", "requirements?"],
    "config": ["config", "configuration", "env", "option", "settings?"],
    "api_contract": ["api", "endpoint", "request", "response", "schema"],
    "error_policy": ["error", "exception", "fail", "401", "403", r"5[0-9][0-9]"],
    "decision_log": [r"decid[\p{L}\p{N}_]*", "trade-?off", "rather than", "instead of", "chosen"],
    "architecture": ["architecture", "component", "flow", "diagram", "invariant"],
    "workflow": ["workflow", "process", "step", "pipeline"],
    "troubleshooting": ["troubleshoot", "debug", "root cause", "workaround"],
    "security": ["auth", r"authoriz[\p{L}\p{N}_]*", "token", "permission", "security"],
    "reference": ["reference", "table", "matrix", "lookup"],
}
# Phrases by chunk class, second version; earlier classes win ties.
CHUNK_CLASSES = {
    "decisions": [r"decid[\p{L}\p{N}_]*", "trade-?off", "chosen", "rather than", "instead of"],
    "problems": ["error", "fail", "issue", "bug", "workaround", "root cause"],
    "milestones": ["shipped", "implemented", "completed", "launched", "deployed"],
    "technical": ["api", "config", "schema", "database", "class", "function", "token"],
}
# Phrases by chunk class, first version.
CHUNK_CLASSES_FIRST = {
    "decisions": ["let'?s (?:use|go with|try|pick|choose|switch to)", "we (?:should|decided|chose|went with|picked|settled on)", "instead of", "rather than", "trade-?off", "architecture", "approach", "strategy", "framework", "infrastructure", "configure"],
    "problems": ["(?:bug|error|crash|fail|broke|broken|issue|problem)", "doesn'?t work", "not working", "root cause", "the fix (?:is|was)", "workaround"],
    "milestones": ["it works", "fixed", "solved", "finally", "implemented", "shipped", "launched", "deployed"],
    "technical": ["api", "endpoint", "function", "class", "interface", "schema", "database", "config", "install", "setup", "deploy", "docker", "http", "rest", "graphql", "sql"],
}
#: Order in which classes of rooms are listed.
CLASS_ORDER = {"decisions": 0, "technical": 1, "problems": 2, "milestones": 3, "reference": 4}


def phrase(body: str) -> str:
    """Pattern of a phrase as a whole word."""
    return f"{_L}(?:{body}){_R}"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\f\x0b"))


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_words(text: str) -> list[str]:
    """Words of a query without stop words and single Latin letters; if none is left, the first ten words of two letters."""
    import re

    raw = re.findall(r"\w+", text.lower())
    kept = [w for w in raw if w not in QUERY_STOP_WORDS and not (len(w) < 2 and w.isascii() and w.isalpha())]
    return list(dict.fromkeys(kept or [w for w in raw if len(w) >= 2][:10]))


def windows(c: Column, size: int, overlap: int) -> Column:
    """Array of stripped, non-blank windows of size characters that overlap; the last begins before the text is covered.

    The text is cut once into pieces of a step, and a window is a piece and the beginning of the next, so the work grows with the text's
    length and not with its square, as it does where each window is counted out from the text's start.
    """
    step = max(1, size - max(0, overlap))
    text = strip(F.coalesce(c, F.lit("")))
    last = F.greatest(F.length(text) - F.lit(size) + F.lit(step - 1), F.lit(0))
    if size <= 2 * step:
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
        after = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(0)))
        whole = F.zip_with(pieces, after, lambda a, b: strip(F.concat(a, F.coalesce(F.substring(b, 1, size - step), F.lit("")))))
        return F.filter(F.slice(whole, F.lit(1), F.floor(last / step).cast("int") + 1), lambda x: x != "")
    return F.filter(F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: strip(F.substring(text, s + 1, F.lit(size)))), lambda x: x != "")


def slug(c: Column) -> Column:
    """Lower case, runs of other than letters and digits as one underscore, none at the ends; `default` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "default").otherwise(s)


def wing(path: Column, root: str = "root") -> Column:
    """First folder of a relative path; the root's name for a file beside it."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, parts[0]).otherwise(F.lit(root))


def room(path: Column) -> Column:
    """Slug of a relative path without its suffix."""
    stem = F.regexp_replace(path, r"([^/])\.[^./]*$", "$1")
    s = F.regexp_replace(F.regexp_replace(F.lower(stem), r"[ _/]", "-"), r"[^a-z0-9-]", "")
    s = F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", "")
    return F.when(s == "", "general").otherwise(s)


def html_plain(c: Column) -> Column:
    """Tags to a space, white space to one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "), f"{_SPACE}+", " "))


def html_snippet(c: Column, n: int = 300) -> Column:
    return F.substring(html_plain(c), 1, n)


def headings(c: Column, most: int = 12) -> Column:
    """Markdown headings and short title-like lines, in order."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), strip)
    title = lambda x: x.rlike("^#{1,6}[ \t]+") | (x.rlike(r"^[A-Z][A-Za-z0-9 /:_-]{3,80}$") & ~x.rlike("[:;]$"))
    return F.slice(F.transform(F.filter(lines, title), lambda x: strip(F.regexp_replace(x, "^#{1,6}[ \t]+", ""))), 1, most)


def topic_words(c: Column) -> Column:
    """Normalised topic words in order: ASCII words of three letters and more, cut at - _ /, without stop words."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9_/-]{2,}"), F.lit(0))
    parts = F.regexp_extract_all(F.lower(F.array_join(found, " ")), F.lit("[a-z0-9]{3,}"), F.lit(0))  # what was found holds letters, digits and - _ / only
    return F.filter(parts, lambda x: ~x.isin(*STOP_WORDS, *COMMON_TOPICS))


def acronyms(c: Column) -> Column:
    """All-capital words of two to five characters, in order, with repeats."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<![\p{L}\p{N}_])[A-Z][A-Z0-9]{1,4}(?![\p{L}\p{N}_])"), F.lit(0))
    return F.filter(found, lambda x: ~x.isin("THE", "AND"))


def most_frequent(c: Column, most: int, least: int = 1) -> Column:
    """The most frequent words of an array of words without white space, those seen at least so often, ties by first appearance. Arrow-batched: Spark counts within groups of rows, not within a row."""

    @F.pandas_udf("array<string>")
    def top(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [w for w, n in Counter((x or "").split()).most_common(most) if n >= least])

    return top(F.array_join(c, " "))


def _needed(body: str) -> list[str] | None:
    """Literals of which a text that holds the phrase has one: the beginnings of its alternatives; None if one begins otherwise."""
    import re

    depth, parts = 0, [""]
    for ch in body:
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if ch == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += ch
    out = []
    for p in parts:
        start = re.match(r"[^\[\](){}.*+?|\\^$]*", p)[0]
        out.append(start[:-1] if p[len(start) : len(start) + 1] in ("?", "*", "{") else start)
    return out if all(out) else None


def phrase_score(text: Column, bodies: list[str]) -> Column:
    """How many of the phrases occur in lower-case text. A plain search for a phrase's beginning comes before its pattern, which few texts then need."""

    def has(b: str) -> Column:
        need = _needed(b)
        found = text.rlike(phrase(b))
        return reduce(lambda x, y: x | y, [F.contains(text, F.lit(n)) for n in need]) & found if need else found

    return reduce(lambda a, b: a + b, [has(b).cast("int") for b in bodies])


def lowered(c: Column, of) -> Column:
    """of(the lower-case text), which is made once for all that of asks of it."""
    return F.transform(F.array(F.lower(F.coalesce(c, F.lit("")))), of)[0]


def question_types(c: Column, most: int = 5) -> Column:
    """Names of question types by descending (score, name)."""
    scored = lowered(c, lambda low: F.array(*[F.struct(phrase_score(low, v).alias("s"), F.lit(k).alias("n")) for k, v in QUESTION_TYPES.items()]))
    return F.transform(F.slice(F.reverse(F.array_sort(F.filter(scored, lambda x: x["s"] > 0))), 1, most), lambda x: x["n"])


def _first_best(scores: Column, names: list[str]) -> Column:
    """The first name of the highest of some scores; `reference` if none is positive."""
    return F.transform(F.array(scores), lambda s: F.when(F.array_max(s) <= 0, "reference").otherwise(F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(s, F.array_max(s)).cast("int"))))[0]


def chunk_class_first(c: Column) -> Column:
    return _first_best(lowered(c, lambda low: F.array(*[phrase_score(low, v) for v in CHUNK_CLASSES_FIRST.values()])), list(CHUNK_CLASSES_FIRST))


def chunk_class(c: Column) -> Column:
    """Class of a chunk; a heading or a step word counts for `technical`."""
    head = F.coalesce(c.rlike(r"(?m)^#{1,6}\s+").cast("int"), F.lit(0))
    one = lambda low, k, v: phrase_score(low, v) + (head + phrase_score(low, ["step|workflow|procedure|pipeline"]) if k == "technical" else F.lit(0))
    return _first_best(lowered(c, lambda low: F.array(*[one(low, k, v) for k, v in CHUNK_CLASSES.items()])), list(CHUNK_CLASSES))


def addresses(c: Column) -> Column:
    """Trimmed, non-empty addresses between commas and semicolons."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def fact(subject: Column, predicate: Column, obj: Column) -> Column:
    """(subject, predicate, object) as a sentence for embedding, parts cut to 80, 40 and 80 characters."""
    return F.concat(F.lit("("), F.substring(subject, 1, 80), F.lit(", "), F.lower(F.substring(predicate, 1, 40)), F.lit(", "), F.substring(obj, 1, 80), F.lit(")"))


# Characters trimmed from both ends of an entity name.
_TRIMMED = "[ \\t\\r\\n\"'`«»“”‘’()\\[\\]{}<>.,;:!?]"


def _compatible() -> tuple[str, str]:
    """Characters whose NFKC form is one other character, such as full-width letters, and these forms."""
    pairs = [(chr(i), unicodedata.normalize("NFKC", chr(i))) for i in [*range(0xA0, 0xD800), *range(0xF900, 0xFFF0)]]
    pairs = [(c, n) for c, n in pairs if n != c and len(n) == 1]
    return "".join(c for c, _ in pairs), "".join(n for _, n in pairs)


_WIDE, _PLAIN = _compatible()


def canonical(c: Column) -> Column:
    """Entity name without quotes, brackets and punctuation at the ends, white space as one space, lower case, after the part of NFKC that maps single characters to single ones. For ligatures, fractions and separate accents use `canonical_nfkc`."""
    given = F.coalesce(c, F.lit(""))
    name = F.when(F.octet_length(given) == F.length(given), given).otherwise(F.translate(given, _WIDE, _PLAIN))  # ASCII has no such characters
    bare = F.regexp_replace(name, f"^{_TRIMMED}+|{_TRIMMED}+$", "")
    return F.lower(F.regexp_replace(bare, f"{_SPACE}+", " "))


def canonical_nfkc(c: Column) -> Column:
    """`canonical` after NFKC normalisation, which Spark has no function for: an Arrow-batched UDF."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return canonical(nfkc(c))


def entity_id(c: Column) -> Column:
    return F.substring(F.sha1(canonical(c)), 1, 16)


def triple_id(chunk: Column, subj: Column, pred: Column, obj: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", chunk, subj, pred, obj)), 1, 20)


def point_id(chunk: Column) -> Column:
    """Integer id of a chunk in a vector collection: 15 hex digits of its md5."""
    return F.conv(F.substring(F.md5(chunk), 1, 15), 16, 10).cast("long")
