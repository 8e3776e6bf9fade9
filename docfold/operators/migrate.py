"""Message migration and version differences."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def field(part: Column, name: str, kind: str = "string") -> Column:
    """A part's field; null where the part has none, or none of that kind."""
    return F.try_variant_get(part, f"$.{name}", kind)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often the functions within ask for it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def parts_of(content: Column) -> Column:
    """Content as an array of variants, one for each part with all its fields; what isn't a JSON array is one text part."""
    text = F.array(F.to_variant_object(F.struct(F.lit("text").alias("type"), content.alias("text"))))
    return F.coalesce(F.try_variant_get(F.try_parse_json(content), "$", "array<variant>"), text)


def message_rank(role: Column, parts: Column) -> Column:
    """G1: order among messages of one time: calls, their results, answers, others."""
    has = lambda t: F.exists(parts, lambda p: F.coalesce(field(p, "type") == t, F.lit(False)))
    return F.when((role == "assistant") & has("tool-call"), 0).when((role == "tool") & has("tool-result"), 1).when(role == "assistant", 2).otherwise(3)


def message_sections(messages: DataFrame) -> DataFrame:
    """Adds ``rank`` and ``section``: each user message opens one; what comes before the first is section 0."""
    ranked = messages.withColumn("rank", message_rank(F.col("role"), parts_of(F.col("content"))))
    run = Window.partitionBy("chat_id").orderBy("created_at", "rank", "id").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("section", F.sum((F.col("role") == "user").cast("int")).over(run))


def dedupe_parts(parts: Column) -> Column:
    """The first part of each type and content, or of each whole part where it has no content.

    Contents are compared as JSON of any shape; the order of an object's fields makes no difference.
    """

    def key(p: Column) -> Column:
        content = field(p, "content", "variant")
        return F.concat(F.coalesce(field(p, "type"), F.lit("")), F.lit("|"), F.to_json(F.when(content.isNull() | F.is_variant_null(content), p).otherwise(content)))

    firsts = lambda all_: once(F.transform(all_, key), lambda keys: F.filter(all_, lambda p, i: F.array_position(keys, F.get(keys, i)) == i + 1))
    return once(parts, firsts)


def drop_undefined_reasoning(parts: Column) -> Column:
    """Without reasoning parts that say ``undefined``."""
    return F.filter(parts, lambda p: ~(F.coalesce(field(p, "type") == "reasoning", F.lit(False)) & F.coalesce(field(p, "reasoning") == "undefined", F.lit(False))))


def attach_results(parts: Column) -> Column:
    """Each tool call with the result of its ``toolCallId`` (the last one, if there are more), which then goes.

    Results without a call, and calls without a result or with one of their own, stay as they are.
    """
    called = lambda p: F.coalesce(field(p, "type") == "tool-call", F.lit(False)) & field(p, "toolCallId").isNotNull() & field(p, "result", "variant").isNull()
    told = lambda p: F.coalesce(field(p, "type") == "tool-result", F.lit(False))

    def joined(p: Column, results: Column) -> Column:
        body = F.to_json(p)

        def with_result(mine: Column) -> Column:
            found = F.coalesce(F.to_json(field(F.get(mine, F.size(mine) - 1), "result", "variant")), F.lit("null"))
            whole = F.parse_json(F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"result":'), found, F.lit("}")))
            return F.when(F.size(mine) > 0, whole).otherwise(p)

        return F.when(called(p), once(F.filter(results, lambda r: field(r, "toolCallId") == field(p, "toolCallId")), with_result)).otherwise(p)

    def attached(all_: Column) -> Column:
        calls = F.transform(F.filter(all_, called), lambda p: field(p, "toolCallId"))
        rest = once(calls, lambda ids: F.filter(all_, lambda p: ~(told(p) & F.coalesce(F.array_contains(ids, field(p, "toolCallId")), F.lit(False)))))
        return once(F.filter(all_, told), lambda results: F.when(F.size(results) > 0, F.transform(rest, lambda p: joined(p, results))).otherwise(all_))

    return once(parts, attached)


def migrate_messages(messages: DataFrame, votes: DataFrame, id_from: str = "first") -> tuple[DataFrame, DataFrame]:
    """``id, chat_id, role, parts, attachments, created_at`` as user and merged assistant rows, and the votes left.

    Parts are variants and keep every field, whatever its shape: arguments and results of calls, images, files.  A
    section's assistant and tool messages become one assistant row with their parts in order, results attached to
    their calls; its id and time are those of the first assistant message (``id_from="last"``: id of the last).
    Sections without assistant messages keep their user row alone; other roles go.  Attachments start out empty.

    A section's contents meet as JSON text, as variants can't be sorted.
    """
    s = message_sections(messages)
    user = s.filter("role = 'user'").select("id", "chat_id", "role", parts_of(F.col("content")).alias("parts"), "created_at")
    own = F.when(F.col("role") == "assistant", F.struct("created_at", "rank", "id"))
    ordered = F.array_sort(F.collect_list(F.struct("created_at", "rank", "id", "content")))
    merged = (
        s.filter("role in ('assistant', 'tool')").groupBy("chat_id", "section")
        .agg((F.min(own) if id_from == "first" else F.max(own)).alias("own"), F.min(own).alias("first"), ordered.alias("said"))
        .filter("own is not null")
        .withColumn("parts", F.flatten(F.transform("said", lambda x: parts_of(x["content"]))))
        .withColumn("parts", attach_results(F.col("parts")))
        .withColumn("parts", dedupe_parts(F.col("parts")))
        .select(F.col("own.id").alias("id"), "chat_id", F.lit("assistant").alias("role"), drop_undefined_reasoning(F.col("parts")).alias("parts"), F.col("first.created_at").alias("created_at"))
    )
    out = user.unionByName(merged).select("id", "chat_id", "role", "parts", F.array().cast("array<variant>").alias("attachments"), "created_at")
    kept = votes.join(merged.select("chat_id", F.col("id").alias("message_id")), ["chat_id", "message_id"], "left_semi")
    return out, kept


def parts_json(parts: Column) -> Column:
    """Parts as JSON text, as the ``parts`` column of the message table has them."""
    return F.concat(F.lit("["), F.array_join(F.transform(parts, lambda p: F.to_json(p)), ","), F.lit("]"))


MODEL_ROLES = {"user": "human", "assistant": "ai", "system": "system"}


def to_model_messages(messages: DataFrame) -> DataFrame:
    """``id, model_role, text, rejected`` for a language model; roles it doesn't know are rejected."""
    role = F.lit(None).cast("string")
    for k, v in MODEL_ROLES.items():
        role = F.when(F.col("role") == k, v).otherwise(role)
    text = F.array_join(F.transform(F.filter(parts_of(F.col("content")), lambda p: field(p, "type") == "text"), lambda p: field(p, "text")), " ")
    return messages.select("id", role.alias("model_role"), text.alias("text"), role.isNull().alias("rejected"))


def from_model_messages(model: DataFrame) -> DataFrame:
    """G6, back: ``id, role, content``."""
    role = F.lit(None).cast("string")
    for k, v in MODEL_ROLES.items():
        role = F.when(F.col("model_role") == v, k).otherwise(role)
    return model.filter(~F.col("rejected")).select("id", role.alias("role"), F.col("text").alias("content"))


#: Cells of the table that a difference is read from; longer texts are divided first.
TABLE_CELLS = 4_000_000


def _common(p: np.ndarray, q: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence.

    Above :data:`TABLE_CELLS` the first sequence is halved, and the second cut where the halves' common lengths add up to
    most: two rows of lengths are held instead of a table, so memory is linear and time the product at most twice.
    """
    if not len(p) or not len(q):
        return []
    if (len(p) + 1) * (len(q) + 1) > TABLE_CELLS and len(p) > 1:
        half = len(p) // 2
        cut = int((_lengths(p[:half], q) + _lengths(p[half:][::-1], q[::-1])[::-1]).argmax())
        return _common(p[:half], q[:cut]) + [(half + i, cut + j) for i, j in _common(p[half:], q[cut:])]
    # most[i, j]: common items of p from i on and q from j on; a row follows from the one below by a running maximum.
    most = np.zeros((len(p) + 1, len(q) + 1), np.int32)
    for i in range(len(p) - 1, -1, -1):
        best = np.maximum(most[i + 1, :-1], np.where(q == p[i], most[i + 1, 1:] + 1, 0))
        most[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    out = []
    i = j = 0
    while i < len(p) and j < len(q):
        if p[i] == q[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif most[i + 1, j] >= most[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def _lengths(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each j, how many items p and the first j of q have in common at most."""
    row = np.zeros(len(q) + 1, np.int32)
    for x in p:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(q == x, row[:-1] + 1, 0)))
    return row


def minimal_diff(a: list[str], b: list[str]) -> list[tuple[int, str]]:
    """(op, item) from ``a`` to ``b`` along a longest common subsequence: 0 stays, -1 goes, 1 comes.

    Between two common items all that goes comes before what comes.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    code: dict[str, int] = {}
    p, q = (np.array([code.setdefault(s, len(code)) for s in part], np.int64) for part in (x, y))
    # What only one side has can't be common.
    at, to = np.flatnonzero(np.isin(p, q)), np.flatnonzero(np.isin(q, p))
    middle: list[tuple[int, str]] = []
    i = j = 0
    for k, m in [*((int(at[k]), int(to[m])) for k, m in _common(p[at], q[to])), (len(x), len(y))]:
        middle += [(-1, s) for s in x[i:k]] + [(1, s) for s in y[j:m]] + [(0, s) for s in x[k : k + 1]]
        i, j = k + 1, m + 1
    return [(0, s) for s in a[:head]] + middle + [(0, s) for s in a[len(a) - tail :]]


def _sentence_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[{"op": o, "sentence": s} for o, s in minimal_diff(list(a), list(b))] for a, b in zip(old, new)])


def version_diff(versions: DataFrame) -> DataFrame:
    """``id, from_version, to_version, position, op, sentence`` between consecutive versions (-1, 0, 1).

    As few sentences as possible go and come; those at both ends that stay, and those that only one version has, are
    set aside first.  What is left takes linear memory, and time by the product of both versions' sentences.
    """
    from ..functions.text import split_sentences

    diff = F.pandas_udf(_sentence_diff, "array<struct<op:int,sentence:string>>")
    w = Window.partitionBy("id").orderBy("created_at", "content")
    v = versions.select("id", "created_at", "content", split_sentences(F.coalesce("content", F.lit(""))).alias("now")).withColumn("n", F.row_number().over(w) - 1).withColumn("before", F.lag("now").over(w)).filter("before is not null")
    rows = v.select("id", (F.col("n") - 1).alias("from_version"), F.col("n").alias("to_version"), F.posexplode(diff("before", "now")).alias("position", "d"))
    return rows.select("id", "from_version", "to_version", "position", "d.op", "d.sentence")


def version_diff_counts(versions: DataFrame) -> DataFrame:
    """G8, counts: sentences that a version adds and removes against the one before, as multisets."""
    from ..functions.text import split_sentences

    n = F.row_number().over(Window.partitionBy("id").orderBy("created_at", "content")) - 1
    s = versions.select("id", n.alias("version"), split_sentences(F.coalesce("content", F.lit(""))).alias("s"))
    top = s.groupBy("id").agg(F.max("version").alias("last"))
    each = s.select("id", "version", F.explode("s").alias("sentence")).groupBy("id", "version", "sentence").agg(F.count(F.lit(1)).alias("n"))
    moved = each.select("id", "version", "sentence", F.col("n").alias("change")).unionByName(each.select("id", (F.col("version") + 1).alias("version"), "sentence", (-F.col("n")).alias("change")))
    net = moved.groupBy("id", "version", "sentence").agg(F.sum("change").alias("change")).join(top, "id").filter((F.col("version") > 0) & (F.col("version") <= F.col("last")))
    return net.groupBy("id", "version").agg(F.sum(F.greatest("change", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("change"), F.lit(0))).alias("removed"))
