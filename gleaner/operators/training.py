"""Preparing labelled documents for a tagger: pieces, reachable spans, context views, probes, and audits of them."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.arrow import explode_structs, per_text

from . import decode, rules
from .features import Config, featurize
from .spans import MOST_ENTITY_TOKENS, breaks, retained
from .tokens import tokenize

#: Parents that context views are made of.
LEAST_PARENT, MOST_POSITIVE = 128, 0.20
KINDS = decode.DETECTOR_KINDS

Span = tuple[str, int, int]


def pieces(text: str, gold: list[Span], most: int) -> list[tuple[int, int]]:
    """Byte ranges of whole paragraphs, at most ``most`` tokens each unless one alone has more; no cut goes through a span."""
    data = text.encode()
    cuts = [m.end() for m in re.finditer(b"\n\n", data) if not any(s < m.end() < e for _, s, e in gold)] + [len(data)]
    content = [t for t in tokenize(text) if t.is_content]
    size = lambda a, b: sum(a <= t.start and t.end <= b for t in content)
    out, start, last = [], 0, 0
    for cut in cuts:
        if last > start and size(start, cut) > most:
            out.append((start, last))
            start = last
        last = cut
    return [*out, (start, last)] if last > start else out


def unreachable(text: str, gold: list[Span]) -> list[list[str]]:
    """For each span the reasons why no tagger can find it: token_boundary, blank_line, rule_overlap, entity_too_long."""
    toks = tokenize(text)
    kept = retained(toks)
    starts, ends = {toks[i].start for i in kept}, {toks[i].end for i in kept}
    paragraphs = [toks[i].start for i, b in zip(kept, breaks(toks, kept), strict=True) if b == 3]
    found = rules.scan(text)[1]
    out = []
    for _, s, e in gold:
        reasons = {
            "token_boundary": s not in starts or e not in ends, "blank_line": any(s < p < e for p in paragraphs), "rule_overlap": any(s < r.end and r.start < e for r in found),
            "entity_too_long": sum(s <= toks[i].start and toks[i].end <= e for i in kept) > MOST_ENTITY_TOKENS,
        }
        out.append([name for name, on in reasons.items() if on])
    return out


PIECE = "array<struct<start:int,end:int,text:string,spans:array<struct<kind:string,start:int,end:int,reasons:array<string>>>>>"


def document_pieces(docs: DataFrame, keys: list[str], most: int = 512, text_col: str = "text", spans_col: str = "entities") -> DataFrame:
    """One row a piece: (keys, piece_no, start, end, text, spans), spans rebased, each with the reasons against it."""

    def of(text: str | None, spans: list | None) -> list[dict]:
        gold = [(s["kind"], s["start"], s["end"]) for s in spans or ()]
        data, out = (text or "").encode(), []
        for a, b in pieces(text or "", gold, most):
            part = data[a:b].decode()
            own = [(k, s - a, e - a) for k, s, e in gold if a <= s and e <= b]
            listed = [{"kind": k, "start": s, "end": e, "reasons": r} for (k, s, e), r in zip(own, unreachable(part, own), strict=True)]
            out.append({"start": a, "end": b, "text": part, "spans": listed})
        return out

    return explode_structs(per_text(docs, [F.col(text_col), F.col(spans_col)], of, PIECE, "pieces", keys), "pieces", keys, "piece_no")


def closure(anchor: tuple[int, int], gold: list[tuple[int, int]], length: int, radius: int) -> tuple[int, int]:
    """The least range around an anchor in which every span that it meets has the radius on both sides too."""
    a, b = max(0, anchor[0] - radius), min(length, anchor[1] + radius)
    while True:
        met = [(s, e) for s, e in gold if s < b and a < e]
        wide = min([a, *(max(0, s - radius) for s, _ in met)]), max([b, *(min(length, e + radius) for _, e in met)])
        if wide == (a, b):
            return wide
        a, b = wide


def views(text: str, gold: list[Span], radius: int) -> list[tuple[int, int]]:
    """Byte ranges of shorter views of a long document with few names and no address.

    Around each span, as far as features inside the radius stay those of the whole document,
    rule spans aren't cut, and the share of named tokens rises.
    """
    toks = tokenize(text)
    kept = retained(toks)
    bounds = [(toks[i].start, toks[i].end) for i in kept]
    try:
        labels = decode.encode_bio(bounds, [(s, e, KINDS.index(k)) for k, s, e in gold])
    except ValueError:
        return []
    n, positive = len(bounds), sum(x != 0 for x in labels)
    if n < LEAST_PARENT or not positive or positive / n > MOST_POSITIVE or any(k == "address" for k, _, _ in gold):
        return []
    spans = [(next(i for i, b in enumerate(bounds) if b[0] == s), 1 + next(i for i, b in enumerate(bounds) if b[1] == e)) for _, s, e in gold]
    ruled = [(e.start, e.end) for e in rules.scan(text)[1]]
    whole, before = [featurize(toks, ruled)[i] for i in kept], breaks(toks, kept)
    data, out = text.encode(), set()
    for anchor in spans:
        a, b = closure(anchor, spans, n, radius + 1)
        while True:
            left, right = bounds[a][0], bounds[b - 1][1]
            cut = [r for r in ruled if r[0] < right and left < r[1] and (r[0] < left or right < r[1])]
            inside = [i for i, (s, e) in enumerate(bounds) if any(s < y and x < e for x, y in cut)]
            grown = closure((min([a, *inside]), max([b, *(i + 1 for i in inside)])), spans, n, 0)
            if grown == (a, b):
                break
            a, b = grown
        while (a, b) != (0, n):
            left, right = bounds[a][0], bounds[b - 1][1]
            part = data[left:right].decode()
            own = tokenize(part)
            places = retained(own)
            mine, parted = featurize(own, [(x - left, y - left) for x, y in ruled if left <= x and y <= right]), breaks(own, places)
            aligned = [(own[i].start + left, own[i].end + left) for i in places] == bounds[a:b]
            protected = [i for s, e in spans if a <= s and e <= b for i in range(max(0, s - radius), min(n, e + radius))]
            same = aligned and all(a <= i < b and whole[i] == mine[places[i - a]] and (before[i] == 3) == (parted[i - a] == 3) for i in protected)
            if same:
                if sum(x != 0 for x in labels[a:b]) / (b - a) > positive / n:
                    out.add((left, right))
                break
            a, b = max(0, a - 1), min(n, b + 1)
    return sorted(out)


VIEW = "array<struct<start:int,end:int,text:string>>"


def context_views(docs: DataFrame, keys: list[str], radius: int = 16, text_col: str = "text", spans_col: str = "entities") -> DataFrame:
    """One row a view: (keys, view_no, start, end, text)."""

    def of(text: str | None, spans: list | None) -> list[dict]:
        data = (text or "").encode()
        return [{"start": a, "end": b, "text": data[a:b].decode()} for a, b in views(text or "", [(s["kind"], s["start"], s["end"]) for s in spans or ()], radius)]

    return explode_structs(per_text(docs, [F.col(text_col), F.col(spans_col)], of, VIEW, "views", keys), "views", keys, "view_no")


AUDIT = "struct<tokens:int,positive:int,eligible:boolean,windows:int,window_tokens:int,window_positive:int>"


def window_audit(docs: DataFrame, source: str, key: str, radius: int = 16, text_col: str = "text", spans_col: str = "entities") -> DataFrame:
    """(source, docs, tokens, positive, eligible, windows, density, window_density) by source and over all: what windows around spans would gain."""

    def of(text: str | None, spans: list | None) -> dict:
        bounds = [(t.start, t.end) for t in tokenize(text or "") if t.is_content]
        labels = decode.encode_bio(bounds, [(s["start"], s["end"], KINDS.index(s["kind"])) for s in spans or ()])
        n, positive = len(bounds), sum(x != 0 for x in labels)
        fits = n >= LEAST_PARENT and 0 < positive <= MOST_POSITIVE * n
        own = [([b[0] for b in bounds].index(s["start"]), 1 + [b[1] for b in bounds].index(s["end"])) for s in spans or ()]
        ranges = {closure(a, own, n, radius) for a in own} - {(0, n)} if fits else set()
        return {
            "tokens": n, "positive": positive, "eligible": fits, "windows": len(ranges), "window_tokens": sum(b - a for a, b in ranges),
            "window_positive": int(sum(np.count_nonzero(labels[a:b]) for a, b in ranges)),
        }

    rows = per_text(docs, [F.col(text_col), F.col(spans_col)], of, AUDIT, "a", [key, source]).select(source, "a.*")
    total = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    sums = rows.groupingSets([[F.col(source)], []], source).agg(F.count("*").alias("docs"), *[total(c) for c in ("tokens", "positive", "eligible", "windows", "window_tokens", "window_positive")])
    share = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 4)
    return sums.withColumns({"density": share("positive", "tokens"), "window_density": share("window_positive", "window_tokens")})


def probe(real: DataFrame, synthetic: DataFrame, source: str, id_col: str, tokens: str, text_col: str, draw: str, most: int) -> DataFrame:
    """(id, text, real): the shortest and the longest text of each source, ties by id, then synthetic texts by draw up to ``most``, each text once."""
    first = real.groupBy(text_col).agg(F.min(F.struct(source, tokens, id_col)).alias("k")).select(text_col, "k.*")
    short, long = F.struct(tokens, id_col, text_col), F.struct(tokens, id_col, text_col)
    ends = first.groupBy(source).agg(F.min(short).alias("a"), F.max(long).alias("b")).select(F.explode(F.array("a", "b")).alias("e")).select(f"e.{id_col}", f"e.{text_col}").distinct()
    kept = ends.select(id_col, text_col, F.lit(True).alias("real"))
    room = most - kept.count()
    if room < 0:
        raise ValueError("the cap is too small for every source")
    made = synthetic.join(kept.select(text_col), text_col, "left_anti").groupBy(text_col).agg(F.min(F.struct(draw, id_col)).alias("k"))
    return kept.unionByName(made.orderBy("k").limit(room).select(F.col(f"k.{id_col}").alias(id_col), text_col, F.lit(False).alias("real")))


def supported(rows: DataFrame, group: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(group, missing): kinds that a group of (group, entities) has no span of."""
    found = rows.groupBy(group).agg(F.array_distinct(F.flatten(F.collect_list(F.transform("entities", lambda s: s["kind"])))).alias("has"))
    return found.select(group, F.array_except(F.array(*map(F.lit, kinds)), "has").alias("missing")).where(F.size("missing") > 0)


def silver_pieces(rows: DataFrame, id_col: str = "id", most: int = 512) -> DataFrame:
    """(id, piece_no, text, entities, unreachable): pieces of labelled documents, as readers.silver() gives them, with the spans that a tagger can learn, and how many it can't."""
    cut = document_pieces(rows, [id_col], most)
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    learned = F.filter("spans", lambda s: F.size(s["reasons"]) == 0)
    return cut.select(id_col, "piece_no", "text", F.transform(learned, plain).alias("entities"), (F.size("spans") - F.size(learned)).alias("unreachable"))


def nearest_anchor_contacts(entities: DataFrame, keys: list[str], block: str, text: str | None = None) -> DataFrame:
    """entities (keys, block, kind, start, end) with owner, by windows alone: the start of the nearest person before in the block, else of the first; organizations stand in where a block has no person.

    The relational form of the baseline grouper. With a column of the entities' texts, an
    email belongs to the first person of its block one of whose names, of three letters or
    more, it spells between dots, lines and hyphens.
    """
    where = [*keys, block]
    has_person = F.max((F.col("kind") == "person").cast("int")).over(Window.partitionBy(*where)) == 1
    anchor = F.when(has_person, F.col("kind") == "person").otherwise(F.col("kind") == "org")
    at = F.when(F.col("__anchor"), F.col("start"))
    order = Window.partitionBy(*where).orderBy("start", "end", "kind")
    before = F.last(at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    people = F.sum((F.col("__anchor") & (F.col("kind") == "person")).cast("int")).over(Window.partitionBy(*where))
    near = F.coalesce(before, after)
    if text:
        long_ones = lambda words: F.filter(words, lambda w: F.length(w) >= 3)
        names = long_ones(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"))
        named = F.sort_array(F.collect_list(F.when(F.col("kind") == "person", F.struct("start", names.alias("names")))).over(Window.partitionBy(*where)))
        spelled = long_ones(F.split(F.lower(F.substring_index(text, "@", 1)), "[._-]"))
        own = F.get(F.filter(named, lambda p: F.arrays_overlap(p["names"], spelled)), F.lit(0))["start"]
        near = F.coalesce(F.when(F.col("kind") == "email", own), near)
    owner = F.when(F.col("__anchor"), F.col("start")).when((F.col("kind") != "org") | (people == 1), near)
    return entities.withColumn("__anchor", anchor).withColumn("owner", owner).drop("__anchor")


def config(buckets: int = 32_768) -> Config:
    """The feature configuration of the shipped contract."""
    return Config(buckets=buckets)
