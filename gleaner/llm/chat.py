"""Chat formatting of preferences: the turns that chosen and rejected share once, then what each has of its own."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn as the functions below take it.
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Template:
    """How a turn is written: head with its role, text, tail. Texts can't forge marks, as mark in them becomes broken."""

    head: str = "<|{role}|>\n"
    tail: str = "<|end|>\n"
    mark: str = "<|"
    broken: str = "< |"
    learned: tuple[str, ...] = ("assistant",)

    def turn(self, role: str | None, text: str | None) -> tuple[str, str]:
        """(head, text with tail); a null role is ``unknown``, a null text empty."""
        clean = lambda s: s.replace(self.mark, self.broken)
        return self.head.replace("{role}", clean(role or "unknown")), clean(text or "") + self.tail


def common(a: list, b: list) -> int:
    """Length of the longest common prefix."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def render(turns: list[tuple[str | None, str | None]], template: Template) -> tuple[str, list[tuple[int, int]]]:
    """(text, spans): spans are those of its code points that a model learns, the texts and tails of learned roles."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = template.turn(role, text)
        parts += head, body
        at += len(head)
        if role in template.learned:
            spans.append((at, at + len(body)))
        at += len(body)
    return "".join(parts), spans


def conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order of turn, role and text, nulls first; repeated rows stay.

    Rows of a null id are conversations of one turn each, as nothing says which of them
    belong together. A conversation becomes one record here, as any training example is;
    nothing else is ever gathered.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    said = rows.select(F.col(id_col).alias("conv_id"), turn.alias("t"))
    grouped = said.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("all"))
    every = grouped.unionByName(said.where("conv_id is null").select("conv_id", F.array("t").alias("all")))
    return every.select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def stale_replies(found: DataFrame, learned: str = "assistant") -> DataFrame:
    """Pairs of each conversation (conv_id, turns) up to its last reply with one that has a stale reply in it: (pair_id, reply, chosen, rejected).

    A stale reply is the first half of the conversation's first reply, rounded down. It
    stands in for the last reply, so that the sides part at their end, and in another pair
    for the first one, if that isn't the last, so that they part earlier and go on. reply is
    the place of the reply that differs, from 0. Conversations without a reply make no
    pair; without anything to say but an empty reply the two sides are equal.
    """
    places = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == learned, i)), lambda i: i.isNotNull())
    kept = found.withColumn("places", places).where("size(places) > 0").withColumn("chosen", F.expr("slice(turns, 1, array_max(places) + 1)"))
    kept = kept.withColumn("reply", F.explode(F.array_distinct(F.array(F.array_max("places"), F.array_min("places")))))
    first = F.coalesce(F.get(F.col("turns"), F.array_min("places"))["text"], F.lit(""))
    stale = F.struct(F.lit(learned).alias("role"), F.substring(first, F.lit(1), F.floor(F.length(first) / 2).cast("int")).alias("text"))
    rejected = F.transform("chosen", lambda t, i: F.when(i == F.col("reply"), stale).otherwise(t))
    return kept.select(F.col("conv_id").alias("pair_id"), "reply", "chosen", rejected.alias("rejected"))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TEXTS = [("prompt", pa.string()), ("chosen", pa.string()), ("chosen_spans", _SPANS), ("rejected", pa.string()), ("rejected_spans", _SPANS)]


def preferences(pairs: DataFrame, template: Template = Template(), keys: tuple[str, ...] = ("pair_id",), chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """Preference records of pairs of conversations (arrays of role and text).

    (keys, n_common, prompt, chosen, chosen_spans, rejected, rejected_spans): prompt is
    the longest common prefix of whole turns, written once; chosen and rejected are what
    follows it on either side, with the spans of code points that a model learns from; all
    else is masked. Sides may share nothing (empty prompt) or be equal (empty
    completions); a null side has no turns, and neither has an empty one. One row for each
    row of pairs, repeated ones too; keys may be null; other columns are not read.
    """
    spans = "array<struct<start:bigint,end:bigint>>"
    m, types = len(keys), dict(pairs.dtypes)

    def run(batches):
        for b in batches:
            columns: list[list] = [[] for _ in range(6)]
            for a, c in zip(b.column(m).to_pylist(), b.column(m + 1).to_pylist(), strict=True):
                a, c = ([(t and t["role"], t and t["text"]) for t in side or []] for side in (a, c))
                n = common(a, c)
                chosen, rejected = render(a[n:], template), render(c[n:], template)
                values = n, render(a[:n], template)[0], chosen[0], chosen[1], rejected[0], rejected[1]
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            listed = lambda all_spans: pa.array([[{"start": s, "end": e} for s, e in own] for own in all_spans], _SPANS)
            n, prompt, chosen, chosen_spans, rejected, rejected_spans = columns
            arrays = [*b.columns[:m], pa.array(n, pa.int32()), pa.array(prompt, pa.string()), pa.array(chosen, pa.string()), listed(chosen_spans), pa.array(rejected, pa.string()), listed(rejected_spans)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "n_common", *[n for n, _ in _TEXTS]])

    side = lambda c: F.col(c).cast(f"array<{TURN}>")
    source = pairs.select(*keys, side(chosen_col).alias("__chosen"), side(rejected_col).alias("__rejected"))
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)
    return source.mapInArrow(run, f"{named}, n_common int, prompt string, chosen string, chosen_spans {spans}, rejected string, rejected_spans {spans}")


def digest(records: DataFrame) -> DataFrame:
    """Spans as text: start-end, comma-joined; no spans are an empty text, and other columns and repeated rows stay as they are."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    named: dict[str, Column] = {c: joined(c) for c in ("chosen_spans", "rejected_spans")}
    return records.withColumns(named)


def oracle(template: Template = Template(), learned: str = "assistant") -> str:
    """DuckDB SQL of the preference records that stale_replies() makes of table conversations."""
    head, tail = template.head.split("{role}"), template.tail
    lit = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    clean = lambda c: f"replace({c}, {lit(template.mark)}, {lit(template.broken)})"
    heading = f"{lit(head[0])} || {clean('coalesce(role, ' + lit('unknown') + ')')} || {lit(head[1])}"
    body = lambda c: f"{clean(f"coalesce({c}, '')")} || {lit(tail)}"

    def side(c: str, name: str) -> str:
        """The text of a side's own turns, and the spans of learned ones in it."""
        return f"""string_agg(head || {c}, '' ORDER BY i) FILTER (i > n_common) AS {name},
  string_agg(({c}_upto - length({c})) || '-' || {c}_upto, ',' ORDER BY i) FILTER (i > n_common AND role = '{learned}') AS {name}_spans"""

    upto = lambda c: f"sum(CASE WHEN i > n_common THEN length(head || {c}) ELSE 0 END) OVER (PARTITION BY pair_id, alone, reply ORDER BY i) AS {c}_upto"
    return f"""
WITH s AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS alone FROM conversations),
t AS (SELECT conv_id, alone, role, text, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS i FROM s),
c AS (SELECT conv_id, alone, max(i) FILTER (role = '{learned}') AS last, min(i) FILTER (role = '{learned}') AS first, arg_min(coalesce(text, ''), i) FILTER (role = '{learned}') AS opening FROM t GROUP BY ALL),
k AS (SELECT conv_id, alone, last, opening, last AS reply FROM c WHERE last IS NOT NULL UNION ALL SELECT conv_id, alone, last, opening, first FROM c WHERE first < last),
a AS (SELECT k.conv_id AS pair_id, t.alone, reply, i, role, text, CASE WHEN i = reply THEN substr(opening, 1, CAST(floor(length(opening) / 2) AS BIGINT)) ELSE text END AS other FROM t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id AND t.alone = k.alone AND i <= last),
n AS (SELECT *, coalesce(min(CASE WHEN text IS DISTINCT FROM other THEN i END) OVER (PARTITION BY pair_id, alone, reply) - 1, max(i) OVER (PARTITION BY pair_id, alone, reply)) AS n_common FROM a),
e AS (SELECT pair_id, alone, reply, i, role, n_common, {heading} AS head, {body("text")} AS yes, {body("other")} AS no FROM n),
u AS (SELECT *, {upto("yes")}, {upto("no")} FROM e),
p AS (SELECT pair_id, reply, CAST(max(n_common) + 1 AS INTEGER) AS n_common, string_agg(head || yes, '' ORDER BY i) FILTER (i <= n_common) AS prompt, {side("yes", "chosen")}, {side("no", "rejected")} FROM u GROUP BY pair_id, alone, reply)
SELECT pair_id, CAST(reply AS INTEGER) AS reply, n_common, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(chosen_spans, '') AS chosen_spans,
  coalesce(rejected, '') AS rejected, coalesce(rejected_spans, '') AS rejected_spans FROM p
"""
