"""Text functions: ``Column -> Column``, built-in expressions, and Arrow helpers where those can't say it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the source rules mean it: ASCII, no-break, and the Unicode blanks.  Java and RE2 both read it.
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CONTROL = r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]"

# Fixed values.
STOP_WORDS = (
    "the a an and or but is are was were be been being in on at to for with by about like through over before "
    "after since during this that these those they them their what which who whom whose when where why how all "
    "any both each few more most some such no nor not only own same so than too very can will just should now between"
).split()
FILLER_WORDS = "a an and or but is are was were be been being in on at to for with by about like through over before after since during".split()
QUESTION_WORDS = "what how why when where who which".split()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse_ws(c: Column) -> Column:
    # What is white at the ends is one blank by then.
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def _without_controls(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"[\x00{CONTROL[1:]}", "")


def sanitize_keep_format(c: Column | str) -> Column:
    """Control characters go, line ends become ``\\n``, at most three in a row; ends trimmed; null gives ''."""
    x = F.regexp_replace(F.regexp_replace(_without_controls(col(c)), r"\r\n", "\n"), r"\r", "\n")
    return trim_ws(F.regexp_replace(x, r"\n{4,}", "\n\n\n"))


def sanitize_flat(c: Column | str) -> Column:
    """Control characters go, white space becomes single blanks; null gives ''."""
    return collapse_ws(_without_controls(col(c)))


def text_problems(c: Column | str) -> Column:
    """Struct of what sanitising would remove, and ``is_safe``."""
    x = F.coalesce(col(c), F.lit(""))
    nulls, controls = F.regexp_count(x, F.lit(r"\x00")), F.regexp_count(x, F.lit(CONTROL))
    found = F.concat(F.when(nulls > 0, F.array(F.lit("\0"))).otherwise(F.array().cast("array<string>")), F.array_distinct(F.regexp_extract_all(x, F.lit(f"({CONTROL})"), 1)))
    return F.struct(
        (nulls > 0).alias("has_null_bytes"), (controls > 0).alias("has_control_chars"), nulls.cast("long").alias("null_bytes"), controls.cast("long").alias("control_chars"),
        found.alias("problem_chars"), ((nulls == 0) & (controls == 0)).alias("is_safe"),
    )


# Entities, in the order in which they are decoded.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]


def html_to_text(c: Column | str) -> Column:
    """T4: one line of text from HTML."""
    x = F.coalesce(col(c), F.lit(""))
    for p in (r"(?i)<\?xml[^>]*>", r"(?i)<!DOCTYPE[^>]*>", r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>"):
        x = F.regexp_replace(x, p, "")
    for entity, plain in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(plain))
    x = F.regexp_replace(x, r"(?i)</?(p|div|br|h[1-6]|li|tr)[^>]*>", "\n")
    return collapse_ws(F.regexp_replace(x, r"<[^>]*>", " "))


def clean_book_text(c: Column | str) -> Column:
    """T5: book text without markup, scripts and entities; a blank between sentences; then T1."""
    x = F.coalesce(col(c), F.lit(""))
    for p in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?i)javascript:", r"(?i)on\w+\s*="):
        x = F.regexp_replace(x, p, "")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"&nbsp;", " "), r"&[a-zA-Z0-9#]+;", " ")
    x = F.regexp_replace(x, f"{WS}+", " ")
    return sanitize_keep_format(F.regexp_replace(x, r"([.!?])\s*([A-Z])", "$1 $2"))


def summarize(c: Column | str, size: int = 150) -> Column:
    """The text on one line, cut at the last blank within ``size``.

    Only what can reach the summary is read: as many characters (a run of white space is one) as decide it.
    """
    x = collapse_ws(F.regexp_extract(col(c), f"^{WS}*+((?:{WS}++|(?!{WS})(?s:.)){{0,{size + 2}}})", 1))
    head = F.substring(x, 1, size + 1)
    cut = F.regexp_extract(head, r"(?s)^(.+) ", 1)
    return F.when(F.length(x) <= size, x).otherwise(F.concat(F.when(cut != "", cut).otherwise(F.substring(x, 1, size)), F.lit("...")))


def file_title(c: Column | str) -> Column:
    """Name without its last extension."""
    return F.regexp_replace(col(c), r"\.[^/.]+$", "")


def token_estimate(c: Column | str, count_tokens: Callable[[str], int] | None = None) -> Column:
    """A token for every four characters, or what ``count_tokens`` (an exact tokenizer, run in Arrow batches) says.

    A null text has null tokens either way.
    """
    if count_tokens is None:
        return F.ceil(F.length(col(c)) / 4)

    @F.pandas_udf("long")
    def exact(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else int(count_tokens(t))).astype("Int64")

    return exact(col(c))


def bpe_token_count(rank_file: str, pattern: str) -> Callable[[Column], Column]:
    """T9, exact: counts the tokens of byte-pair ranks (``tiktoken`` file format); null counts none.

    The ranks are read once in each Python worker, from a path that all of them see.
    """

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in texts:
            yield batch.map(lambda t: len(bpe.encode_ordinary(t)) if t else 0).astype("int64")

    return lambda c: count(c)


def preprocess_query(c: Column | str) -> Column:
    """One line without filler words."""
    # White space borders words alike, collapsed or not, so it is collapsed once.
    return collapse_ws(F.regexp_replace(col(c), rf"(?i)(?<![A-Za-z0-9_])({'|'.join(FILLER_WORDS)})(?![A-Za-z0-9_])", " "))


def extract_keywords(c: Column | str) -> Column:
    """Lower-case words of two characters or more that aren't stop words; repeats stay."""
    # All but letters, digits and underscores part words, as white space does.
    plain = F.regexp_replace(F.translate(col(c), "\"'", ""), "[^A-Za-z0-9_]+", " ")
    words = F.split(F.lower(plain), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def query_variations(c: Column | str) -> Column:
    """The query, without its question word, and its keywords; distinct, in that order."""
    q = col(c)
    keys = extract_keywords(q)
    joined = F.array_join(keys, " ")
    asks = rf"(?i)^({'|'.join(QUESTION_WORDS)})(?![A-Za-z0-9_])"
    bare = F.when(q.rlike(asks), F.regexp_replace(q, rf"(?i)^({'|'.join(QUESTION_WORDS)}){WS}+", ""))
    short = F.when((F.size(F.split(q, f"{WS}+")) > 2) & (F.size(keys) > 1) & (F.lower(joined) != F.lower(q)), joined)
    return F.array_distinct(F.array_compact(F.array(q, bare, short)))


# Threshold rules: (words below, floor, change) in order, then of longer queries (cap, change), of questions and
#: of quoted queries (floor, change).
THRESHOLDS = {
    "default": ([(3, 0.18, -0.15), (5, 0.20, -0.10), (8, 0.22, -0.05)], (0.40, 0.05), (0.18, -0.05), (0.16, -0.07)),
    "debug": ([(3, 0.15, -0.25), (5, 0.18, -0.20), (8, 0.20, -0.15)], (0.40, 0.05), (0.18, -0.08), (0.15, -0.12)),
}


def dynamic_threshold(query: Column | str, least: Column | float, profile: str = "default") -> Column:
    """The similarity a query's results must reach, from its length and form."""
    q, m = col(query), F.least(F.greatest(F.lit(least) if not isinstance(least, Column) else least, F.lit(0.0)), F.lit(1.0))
    n = F.size(F.split(q, f"{WS}+", -1))
    if profile == "strict":
        return F.when(n < 3, F.greatest(F.lit(0.3), m - 0.1)).when(n > 7, F.least(F.lit(0.5), m + 0.05)).otherwise(m)
    steps, (cap, up), (q_floor, q_down), (s_floor, s_down) = THRESHOLDS[profile]
    out = F.least(F.lit(cap), m + up)
    for below, floor, down in reversed(steps):
        out = F.when(n < below, F.greatest(F.lit(floor), m + down)).otherwise(out)
    asks = q.rlike(rf"(?i)(?<![A-Za-z0-9_])({'|'.join(QUESTION_WORDS)})(?![A-Za-z0-9_])")
    out = F.when(asks, F.greatest(F.lit(q_floor), out + q_down)).otherwise(out)
    return F.when(F.contains(q, F.lit('"')), F.greatest(F.lit(s_floor), out + s_down)).otherwise(out)


# Fixed values.
LABELS = {
    "default": [(0.75, "Highly Relevant"), (0.6, "Very Relevant"), (0.45, "Relevant"), (0.3, "Somewhat Relevant"), (0.2, "Potentially Relevant")],
    "strict": [(0.8, "Highly Relevant"), (0.65, "Very Relevant"), (0.5, "Relevant"), (0.3, "Somewhat Relevant")],
}


def relevance_label(similarity: Column | str, profile: str = "default") -> Column:
    """Words for a similarity."""
    out = F.lit("Low Relevance")
    for least, label in reversed(LABELS[profile]):
        out = F.when(col(similarity) >= least, label).otherwise(out)
    return out


def search_suggestions(query: Column | str) -> Column:
    """Shorter forms of a query, distinct, in order."""
    t = F.split(col(query), f"{WS}+")
    n = F.size(t)
    return F.array_distinct(
        F.array_compact(F.array(F.when(n > 1, F.array_join(F.slice(t, F.lit(1), F.greatest(n - 1, F.lit(0))), " ")), F.when(n > 2, F.array_join(F.slice(t, F.lit(2), n), " ")), F.array_join(t, " AND "), F.element_at(t, 1)))
    )


PARTS = "array<struct<type:string,text:string>>"


def message_text(parts: Column | str, form: str = "prompt") -> Column:
    """Text parts of a message, joined by blanks, or (``copy``) by lines and trimmed."""
    texts = F.transform(F.filter(F.from_json(col(parts), PARTS), lambda p: p["type"] == "text"), lambda p: p["text"])
    return F.array_join(texts, " ") if form == "prompt" else trim_ws(F.array_join(texts, "\n"))


def chat_title(content: Column | str) -> Column:
    """A title from a first message."""
    c = col(content)
    return F.when(F.length(c) > 50, F.concat(F.substring(c, 1, 47), F.lit("..."))).otherwise(c)


def format_bytes(n: Column | str) -> Column:
    """Size with a unit, two decimals without trailing zeros."""
    n = col(n).cast("double")
    i = F.least(F.floor(F.log(n) / F.log(F.lit(1024.0))), F.lit(3)).cast("int")
    value = F.floor(n / F.pow(F.lit(1024.0), i) * 100 + 0.5) / 100
    text = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    return F.when(n == 0, "0 Bytes").otherwise(F.concat(text, F.lit(" "), F.element_at(F.array(*map(F.lit, ["Bytes", "KB", "MB", "GB"])), i + 1)))


def blob_folder(kind: Column | str, user: Column | str) -> Column:
    """Folder of a kind of file, and of a user where given."""
    top = F.when(col(kind) == "attachment", "attachments").when(col(kind) == "knowledge", "knowledge").when(col(kind) == "artifact", "artifacts")
    return F.when(col(user).isNull(), top).otherwise(F.concat(top, F.lit("/"), col(user)))


def sanitize_metadata(m: Column | str) -> Column:
    """T2 on the keys and values of a flat map."""
    return sanitize_nested(m, T.MapType(T.StringType(), T.StringType()))


def sanitize_nested(c: Column | str, kind: T.DataType) -> Column:
    """T20 on a column of any type: T2 on each string and map key inside maps, structs and arrays.

    Numbers, flags and times stay; nulls stay null, inside too, except that a null string in a map becomes ''.
    """
    x = col(c)
    if isinstance(kind, T.MapType):
        keys = F.transform_keys(x, lambda k, v: sanitize_nested(k, kind.keyType))
        return F.transform_values(keys, lambda k, v: sanitize_flat(v) if isinstance(kind.valueType, T.StringType) else sanitize_nested(v, kind.valueType))
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: sanitize_nested(v, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[sanitize_nested(x[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return F.when(x.isNotNull(), sanitize_flat(x)) if isinstance(kind, T.StringType) else x


def _clean_json(value):
    flat = lambda t: re.sub(f"{_WS}+", " ", re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "", t)).strip(" ")
    if isinstance(value, dict):
        return {flat(k): _clean_json(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_clean_json(v) for v in value]
    return flat(value) if isinstance(value, str) else value


#: WS as Python reads it.
_WS = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", WS)


def sanitize_json(c: Column | str) -> Column:
    """T20 on metadata of unknown shape, as JSON text: T2 on every key and string; null and broken JSON give null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else json.dumps(_clean_json(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return texts.map(one)

    return clean(col(c))


def user_type(email: Column | str) -> Column:
    """Guest or regular."""
    return F.when(col(email).rlike(r"^guest-\d+$"), "guest").otherwise("regular")


# Fixed values.
IMAGES = ["image/png", "image/jpg", "image/jpeg"]


def message_errors(role: Column | str, content: Column | str, parts: Column | str, attachment_types: Column | str) -> Column:
    """What is wrong with a message; an empty array for a valid one."""
    c, p = col(content), F.from_json(col(parts), PARTS)
    fits = lambda x: F.coalesce(F.length(x).between(1, 2000), F.lit(False))
    checks = [
        (col(role) == "user", "role"),
        (fits(c), "content"),
        (F.forall(p, lambda x: (x["type"] == "text") & fits(x["text"])), "parts"),
        (F.forall(F.coalesce(col(attachment_types), F.array().cast("array<string>")), lambda x: x.isin(IMAGES)), "attachments"),
    ]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for ok, name in checks]))


def split_sentences(c: Column | str) -> Column:
    """Sentences with their closing marks and blanks."""
    return F.regexp_extract_all(col(c), F.lit(r"([^.!?]+[.!?]*\s*)"), 1)


def parse_vector_text(c: Column | str) -> Column:
    """``"[1,2,3]"`` to an array; null stays null."""
    return F.from_json(col(c), "array<float>")


def format_vector_text(c: Column | str) -> Column:
    """An array to ``"[1,2,3]"``; null stays null."""
    return F.concat(F.lit("["), F.array_join(col(c).cast("array<string>"), ","), F.lit("]"))


# The words that spaced-out letters are split into.
PDF_WORDS = (
    "the and for are but not you all can had her was one our out day get has him his how its may new now old see two "
    "who boy did man men put say she too use data science from scratch guide everyone creating predictive model "
    "machine learning analytics fundamental principles basic work this will include scientist analysis about more "
    "know with kind obsessed"
).split()


def _spaced_word(m: re.Match) -> str:
    word = re.sub(r"\s+", "", m[0])
    out = word.lower()
    for w in sorted(PDF_WORDS, key=len, reverse=True):
        out = out.replace(w, f" {w} ")
    out = " ".join(out.split())
    if " " in out:
        return out
    word = re.sub(r"([a-z])([A-Z])", r"\1 \2", word)
    return re.sub(r"(\d)([a-zA-Z])", r"\1 \2", re.sub(r"([a-zA-Z])(\d)", r"\1 \2", word))


def _join_spaced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    runs = re.compile(r"(?a:\b)[a-zA-Z](?:\s+[a-zA-Z]){2,}(?a:\b)")
    for s in batches:
        yield s.map(lambda x: runs.sub(_spaced_word, x) if x is not None else None)


def repair_spaced_letters(c: Column | str) -> Column:
    """Words that extraction has spaced out letter by letter are joined and split by a word list."""
    join = F.pandas_udf(_join_spaced, "string")
    x = join(F.coalesce(col(c), F.lit("")))
    x = F.regexp_replace(x, r"(?<![A-Za-z0-9_])[a-zA-Z]\s+(?=[a-zA-Z](?![A-Za-z0-9_]))", "")
    x = F.regexp_replace(x, f"{WS}+", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"([.!?])\s*([A-Z])", "$1 $2"), r"([a-z])([A-Z])", "$1 $2")
    return trim_ws(x)
