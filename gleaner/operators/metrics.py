"""Scores of predicted spans and contacts. Percentages are worked out from summed counts, never averaged, but where it says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LATENCY_BUCKETS = ((0, "<256"), (256, "256-1023"), (1024, "1024-4095"), (4096, ">=4096"))


def ratio(a: Column, b: Column) -> Column:
    """a / b to four decimals, 0 for a zero denominator."""
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 4)


def with_prf(counts: DataFrame, tp: str = "tp", predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """counts with precision, recall and f1."""
    f1 = ratio(2 * F.col(tp), F.col(predicted) + F.col(gold))
    return counts.withColumns({"precision": ratio(F.col(tp), F.col(predicted)), "recall": ratio(F.col(tp), F.col(gold)), "f1": f1})


def exact_matches(gold: DataFrame, predicted: DataFrame, identity: list[str]) -> DataFrame:
    """predicted with matched: each gold row is used up once, so the second of equal predictions isn't matched unless gold has two."""
    order = Window.partitionBy(*identity).orderBy(F.lit(0))
    numbered = lambda rows: rows.withColumn("__n", F.row_number().over(order))
    right = numbered(gold.select(*identity)).select(*[F.col(c).alias(f"__{c}") for c in identity], F.col("__n").alias("__m"))
    on = F.col("__n") == F.col("__m")
    for c in identity:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = numbered(predicted).join(right, on, "left")
    return joined.withColumn("matched", F.col("__m").isNotNull()).drop("__n", "__m", *[f"__{c}" for c in identity])


def exact_score(gold: DataFrame, predicted: DataFrame, by: list[str], identity: list[str]) -> DataFrame:
    """(by, gold, predicted, tp, precision, recall, f1) of each group, and of all with nulls, by grouping sets."""
    hits = exact_matches(gold, predicted, identity).select(*by, F.lit(0).alias("gold"), F.lit(1).alias("predicted"), F.col("matched").cast("int").alias("tp"))
    rows = hits.unionByName(gold.select(*by, F.lit(1).alias("gold"), F.lit(0).alias("predicted"), F.lit(0).alias("tp")))
    sets = [[F.col(c) for c in by], []]
    counts = rows.groupingSets(sets, *by).agg(*[F.sum(c).alias(c) for c in ("gold", "predicted", "tp")])
    return with_prf(counts)


def _overlapping(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    right = gold.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("start").alias("__start"), F.col("end").alias("__end"))
    on = (F.col("start") < F.col("__end")) & (F.col("__start") < F.col("end"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return predicted.join(right, on, "left_semi")


def lenient_score(gold: DataFrame, predicted: DataFrame, doc: str, by: str = "kind") -> DataFrame:
    """(by, gold, predicted, lenient_gold, lenient_predicted, precision, recall, f1): any overlap of the same kind counts, on either side."""
    count = lambda rows, name: rows.groupBy(by).agg(F.count("*").alias(name))
    keys = [doc, by] if by == "kind" else [doc, by, "kind"]
    found = count(gold, "gold").join(count(predicted, "predicted"), by, "full")
    found = found.join(count(_overlapping(predicted, gold, keys), "lenient_gold"), by, "left").join(count(_overlapping(gold, predicted, keys), "lenient_predicted"), by, "left").fillna(0)
    p, r = ratio(F.col("lenient_predicted"), F.col("predicted")), ratio(F.col("lenient_gold"), F.col("gold"))
    return found.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def matching(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """A largest set of pairs (left, right) in which nothing is twice, as right -> left, by augmenting paths."""
    options: dict[int, list[int]] = {}
    for left, right in pairs:
        options.setdefault(left, []).append(right)
    owner: dict[int, int] = {}

    def place(start: int) -> None:
        trail, seen = [(start, iter(options[start]))], set()
        path: list[tuple[int, int]] = []
        while trail:
            left, rest = trail[-1]
            right = next((r for r in rest if r not in seen), None)
            if right is None:
                trail.pop()
                if path:
                    path.pop()
                continue
            seen.add(right)
            path.append((left, right))
            if right not in owner:
                owner.update({r: x for x, r in path})
                return
            trail.append((owner[right], iter(options[owner[right]])))

    for left in options:
        place(left)
    return owner


def overlapping(left: list[list[int]], right: list[list[int]], least_iou: float = 0.0) -> list[tuple[int, int]]:
    """Pairs (place in left, place in right) of spans that overlap, in a sweep over starts: only open spans meet."""
    events = sorted([(s, 0, i) for i, (s, _) in enumerate(left)] + [(s, 1, i) for i, (s, _) in enumerate(right)])
    spans, still, pairs = (left, right), ([], []), []
    for at, side, i in events:
        end, other = spans[side][i][1], spans[1 - side]
        still[1 - side][:] = [j for j in still[1 - side] if other[j][1] > at]
        for j in still[1 - side] if end > at else ():
            shared, whole = min(end, other[j][1]) - at, max(end, other[j][1]) - min(at, other[j][0])
            if shared > 0 and shared >= least_iou * whole:
                pairs.append((j, i) if side else (i, j))
        still[side].append(i)
    return sorted(pairs)


def _cluster_matches(first, start, end, side, least_iou: float):
    """Sizes of largest matchings of groups of spans: first marks where a group begins, spans of a group are in order of start. Arrays in, an array out.

    Spans that hang together by overlaps are a cluster. With a single span of a side it has
    one match, if any pair overlaps enough; only larger ones are matched by paths.
    """
    import numpy as np

    group = np.cumsum(first) - 1
    total = np.zeros(int(group[-1]) + 1, np.int64)
    real = end > start  # others overlap nothing
    group, start, end, side = (x[real] for x in (group, start, end, side))
    if not len(group):
        return total
    low = min(int(start.min()), 0)
    step = int(end.max()) - low + 1
    a, b = start - low + group * step, end - low + group * step
    opens = np.ones(len(a), bool)
    opens[1:] = a[1:] >= np.maximum.accumulate(b)[:-1]
    cluster = np.cumsum(opens) - 1
    sizes = [np.bincount(cluster[side == k], minlength=int(cluster[-1]) + 1) for k in (0, 1)]
    least, places = np.minimum(*sizes), np.flatnonzero(opens)
    hard = least > 1 if least_iou <= 0 else least > 0
    for k in np.flatnonzero(hard):
        own = slice(places[k], places[k] + sizes[0][k] + sizes[1][k])
        spans = np.stack([start[own], end[own]], 1)
        least[k] = len(matching(overlapping(spans[side[own] == 1].tolist(), spans[side[own] == 0].tolist(), least_iou)))
    np.add.at(total, group[places], least)
    return total


def one_to_one(gold: DataFrame, predicted: DataFrame, doc: str, least_iou: float = 0.0) -> DataFrame:
    """(doc, kind, matched): sizes of largest one-to-one matchings of overlapping spans of a kind, document by document.

    Spans come sorted, in Arrow batches, many documents at a time.
    """
    keys = [doc, "kind"]
    side = lambda rows, k: rows.select(*keys, *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("start", "end")], F.lit(k).alias("side"))
    every = side(gold, 0).unionByName(side(predicted, 1))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def begins(table):
            found = np.zeros(table.num_rows, bool)
            found[0] = True
            for k in (0, 1):
                now, old = table.column(k).slice(1), table.column(k).slice(0, table.num_rows - 1)
                same = pc.or_(pc.fill_null(pc.equal(now, old), False), pc.and_(now.is_null(), old.is_null()))
                found[1:] |= ~same.to_numpy()
            return found

        def matched(table, first):
            columns = [table.column(k).to_numpy() for k in (2, 3, 4)]
            heads = table.select([0, 1]).take(pa.array(np.flatnonzero(first)))
            return heads.append_column("matched", pa.array(_cluster_matches(first, *columns, least_iou), pa.int32())).combine_chunks().to_batches()

        held: list = []  # rows of the last group so far, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and not begins(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch]))[1:].any():
                held.append(batch)
                continue
            table = pa.Table.from_batches([*held, batch])
            first = begins(table)
            last = int(np.flatnonzero(first)[-1])
            if last:
                yield from matched(table.slice(0, last), first[:last])
            held = table.slice(last).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from matched(table, begins(table))

    types = dict(every.dtypes)
    return every.repartition(*keys).sortWithinPartitions(*keys, "start").mapInArrow(run, f"`{doc}` {types[doc]}, kind {types['kind']}, matched int")


def false_positive_rate(gold: DataFrame, predicted: DataFrame, docs: DataFrame, doc: str) -> DataFrame:
    """(kind, docs, rate): the share of all documents with a prediction that overlaps nothing of its kind."""
    hits = _overlapping(gold, predicted, [doc, "kind"]).select(doc, "kind", "start", "end").distinct()
    false = predicted.join(hits, [doc, "kind", "start", "end"], "left_anti")
    total = docs.agg(F.count("*").alias("total"))
    return false.groupBy("kind").agg(F.countDistinct(doc).alias("docs")).crossJoin(F.broadcast(total)).withColumn("rate", ratio(F.col("docs"), F.col("total"))).drop("total")


def error_classes(gold: DataFrame, predicted: DataFrame, doc: str) -> DataFrame:
    """predicted with error: exact, duplicate, boundary, wrong_kind or no_overlap."""
    identity = [doc, "kind", "start", "end"]
    marked = exact_matches(gold, predicted, identity)
    right = gold.select(F.col(doc).alias("__doc"), F.col("kind").alias("__kind"), F.col("start").alias("__start"), F.col("end").alias("__end"))
    same = (F.col("kind") == F.col("__kind")).cast("int")
    equal = same * ((F.col("start") == F.col("__start")) & (F.col("end") == F.col("__end"))).cast("int")
    on = (F.col(doc) == F.col("__doc")) & (F.col("start") < F.col("__end")) & (F.col("__start") < F.col("end"))
    seen = marked.select(*identity).distinct().join(right, on).groupBy(*identity).agg(F.max(equal).alias("__equal"), F.max(same).alias("__same"))
    kind = F.when(F.col("matched"), "exact").when(F.col("__equal") == 1, "duplicate").when(F.col("__same") == 1, "boundary").when(F.col("__same") == 0, "wrong_kind").otherwise("no_overlap")
    return marked.join(seen, identity, "left").withColumn("error", kind).drop("__equal", "__same")


def errors_both_ways(gold: DataFrame, predicted: DataFrame, doc: str) -> DataFrame:
    """(side, doc, kind, start, end, error): what is wrong with predictions, and what became of gold spans."""
    columns = [doc, "kind", "start", "end"]
    of = lambda side, a, b: error_classes(a, b, doc).select(F.lit(side).alias("side"), *columns, "error")
    return of("predicted", gold.select(*columns), predicted.select(*columns)).unionByName(of("gold", predicted.select(*columns), gold.select(*columns)))


def macro_f1(gold: DataFrame, predicted: DataFrame, identity: list[str], kinds: tuple[str, ...] = ("person", "org", "address")) -> DataFrame:
    """(macro_f1): the mean over kinds of the F1 of exact spans; a kind that neither side has counts as 0."""
    by_kind = exact_score(gold, predicted, ["kind"], identity).where(F.col("kind").isin(list(kinds)))
    return by_kind.agg((F.coalesce(F.sum("f1"), F.lit(0.0)) / len(kinds)).alias("macro_f1"))


def component_scores(gold: DataFrame, predicted: DataFrame, key: str, by: str = "country") -> DataFrame:
    """(country, label, gold, predicted, tp, precision, recall, f1) of components (key, country, label, start, end): by label, by country and over all."""
    identity = [key, "label", "start", "end"]
    hits = exact_matches(gold, predicted, identity).select(by, "label", F.lit(0).alias("gold"), F.lit(1).alias("predicted"), F.col("matched").cast("int").alias("tp"))
    rows = hits.unionByName(gold.select(by, "label", F.lit(1).alias("gold"), F.lit(0).alias("predicted"), F.lit(0).alias("tp")))
    counts = rows.groupingSets([[F.col("label")], [F.col(by)], []], by, "label").agg(*[F.sum(c).alias(c) for c in ("gold", "predicted", "tp")])
    return with_prf(counts)


def parse_scores(rows: DataFrame, by: str = "country", text: str = "text", gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """(country, rows, exact, exact_rate, characters, correct, accuracy) of addresses with arrays of (label, start, end), and over all with a null.

    A parse is exact if both sides have the same components, as often. A character, white
    space apart, is correct if both sides give it the same label, or none. Rows without a
    text, or with null arrays, have no characters, or no components.
    """
    own = lambda c: F.coalesce(F.transform(c, lambda s: F.struct(s["label"].alias("label"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))), F.array().cast("array<struct<label:string,start:int,end:int>>"))
    base = rows.select(F.col(by).alias(by), F.coalesce(text, F.lit("")).alias("t"), own(gold).alias("g"), own(predicted).alias("p"))
    label_at = lambda spans, at: F.get(F.filter(spans, lambda s: (s["start"] <= at) & (at < s["end"])), F.lit(0))["label"]
    places = F.when(F.length("t") > 0, F.sequence(F.lit(1), F.length("t"))).otherwise(F.array().cast("array<int>"))
    inked = F.filter(places, lambda i: ~F.substring(F.col("t"), i, F.lit(1)).rlike(r"(?U)^\s$"))
    starts = F.transform(inked, lambda i: F.octet_length(F.substring(F.col("t"), F.lit(1), i - 1)))
    right = F.size(F.filter(starts, lambda at: label_at(F.col("g"), at).eqNullSafe(label_at(F.col("p"), at))))
    marked = base.select(by, (F.array_sort("g") == F.array_sort("p")).cast("int").alias("exact"), F.size(inked).alias("characters"), right.alias("correct"))
    counts = marked.groupingSets([[F.col(by)], []], by).agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in ("exact", "characters", "correct")])
    return counts.withColumns({"exact_rate": ratio(F.col("exact"), F.col("rows")), "accuracy": ratio(F.col("correct"), F.col("characters"))})


def align(cases: DataFrame, predictions: DataFrame, key: str, value: str) -> DataFrame:
    """Every case with its predictions; a case left out predicts nothing, a name that is no case is an error."""
    if not predictions.join(cases, key, "left_anti").isEmpty():
        raise ValueError("predictions name unknown cases")
    if not predictions.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("predictions name a case twice")
    empty = F.array().cast(dict(predictions.dtypes)[value])
    return cases.join(predictions.select(key, value), key, "left").withColumn(value, F.coalesce(value, empty))


def calibration(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy, ece): equal bins, the last one closed; ece is the same on each row."""
    place = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    found = rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    all_bins = Window.partitionBy()
    return found.withColumn("ece", F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))).over(all_bins) / F.sum("n").over(all_bins))


def threshold_sweep(rows: DataFrame, score: str, positive: str, thresholds: tuple[float, ...] = (0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """(threshold, tp, predicted, gold, precision, recall, f1) at each threshold, in one pass."""
    at = rows.select(F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), F.col(score).alias("s"), F.col(positive).cast("int").alias("y"))
    over = F.col("s") >= F.col("threshold")
    counts = at.groupBy("threshold").agg(
        F.sum(F.when(over, F.col("y")).otherwise(0)).alias("tp"), F.sum(over.cast("int")).alias("predicted"), F.sum("y").alias("gold")
    )
    return with_prf(counts)


def review_score(rows: DataFrame, by: str = "kind", verdict: str = "verdict") -> DataFrame:
    """(by, correct, wrong_boundary, missing, wrong, precision, recall, accept) of reviewed spans."""
    n = lambda v: F.sum((F.col(verdict) == v).cast("int")).alias(v)
    counts = rows.groupBy(by).agg(*[n(v) for v in ("correct", "wrong_boundary", "missing", "wrong")])
    predicted = F.col("correct") + F.col("wrong_boundary") + F.col("wrong")
    scored = counts.withColumns({"precision": ratio(F.col("correct"), predicted), "recall": ratio(F.col("correct"), F.col("correct") + F.col("missing") + F.col("wrong_boundary"))})
    return scored.withColumn("accept", (F.col("precision") >= 0.85) & (F.col("recall") >= 0.80))


def _by_rank(rows: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """(group, n, ranks): the values at ranks, from 0, of each group; n is the column of its size.

    Equal values are counted before the shuffle, so that a group costs as many rows as it has distinct values.
    """
    counts = rows.groupBy(group, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    order = Window.partitionBy(group)
    upto = counts.withColumn("n", F.sum("__c").over(order)).withColumn("__end", F.sum("__c").over(order.orderBy("__v")))
    at = lambda i: F.max(F.when((F.col("__end") - F.col("__c") <= i) & (i < F.col("__end")), F.col("__v")))
    return upto.groupBy(group).agg(F.max("n").alias("n"), *[at(i).alias(name) for name, i in ranks.items()])


def latency(rows: DataFrame, tokens: str, ms: str) -> DataFrame:
    """(bucket, cases, median_ms): of an even number the upper middle, never a mean."""
    bucket = F.lit(LATENCY_BUCKETS[0][1])
    for least, name in LATENCY_BUCKETS[1:]:
        bucket = F.when(F.col(tokens) >= least, name).otherwise(bucket)
    found = _by_rank(rows.select(bucket.alias("bucket"), F.col(ms).alias("ms")), "bucket", "ms", {"median": F.floor(F.col("n") / 2)})
    return found.select("bucket", F.col("n").alias("cases"), F.round("median", 4).alias("median_ms"))


def stage_timings(rows: DataFrame, stage: str, ms: str) -> DataFrame:
    """(stage, n, median_ms, p95_ms) by rank: element n/2, and element ceil(0.95 n) - 1, from 0."""
    return _by_rank(rows, stage, ms, {"median_ms": F.floor(F.col("n") / 2), "p95_ms": F.ceil(F.col("n") * 0.95) - 1})


def raw_and_kept(gold: DataFrame, spans: DataFrame, identity: list[str], least: dict[str, float]) -> DataFrame:
    """(kind, raw_tp, raw_predicted, kept_tp, kept_predicted, gold) for all spans and for those at their kind's cutoff."""
    kept = F.coalesce(*[F.when(F.col("kind") == k, F.col("confidence") >= v) for k, v in least.items()], F.lit(True))
    score = lambda rows, p: exact_matches(gold, rows, identity).groupBy("kind").agg(F.sum(F.col("matched").cast("int")).alias(f"{p}_tp"), F.count("*").alias(f"{p}_predicted"))
    return gold.groupBy("kind").agg(F.count("*").alias("gold")).join(score(spans, "raw"), "kind", "full").join(score(spans.where(kept), "kept"), "kind", "full").fillna(0)


def forbidden(predicted: DataFrame, must_not: DataFrame, case: str) -> DataFrame:
    """Predictions equal to what a case must not have."""
    return predicted.join(must_not.select(case, "kind", "text").distinct(), [case, "kind", "text"], "left_semi")


def assignments(gold: DataFrame, predicted: DataFrame, doc: str) -> DataFrame:
    """(correct, wrong, missed, accuracy) of members (doc, start, end, kind, owner): the owner is the anchor's start, null if unassigned."""
    keys = [doc, "kind", "start", "end"]
    met = gold.select(*keys, F.col("owner").alias("g")).join(predicted.select(*keys, F.col("owner").alias("p")), keys, "left")
    right, missed = F.col("g").eqNullSafe(F.col("p")), F.col("g").isNotNull() & F.col("p").isNull()
    n = lambda c, name: F.sum(c.cast("int")).alias(name)
    return met.agg(n(right, "correct"), n(~right & ~missed, "wrong"), n(missed, "missed")).withColumn("accuracy", ratio(F.col("correct"), F.col("correct") + F.col("wrong") + F.col("missed")))


def exact_cards(gold: DataFrame, predicted: DataFrame, doc: str) -> DataFrame:
    """(gold, predicted, exact, high, high_exact) of cards (doc, members as a sorted array, confidence): equal members, each gold card once."""
    marked = exact_matches(gold.select(doc, "members"), predicted, [doc, "members"])
    sure = F.col("confidence") >= 0.9
    n = lambda c, name: F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(name)
    found = marked.agg(F.count("*").alias("predicted"), n(F.col("matched"), "exact"), n(sure, "high"), n(sure & F.col("matched"), "high_exact"))
    return gold.agg(F.count("*").alias("gold")).crossJoin(found)


def field_ownership(gold: DataFrame, predicted: DataFrame, doc: str) -> DataFrame:
    """(kind, correct, wrong, missed, accuracy) of members by kind: who is taken to own each email, phone and address."""
    keys = [doc, "kind", "start", "end"]
    met = gold.select(*keys, F.col("owner").alias("g")).join(predicted.select(*keys, F.col("owner").alias("p")), keys, "left")
    right, missed = F.col("g").eqNullSafe(F.col("p")), F.col("g").isNotNull() & F.col("p").isNull()
    n = lambda c, name: F.sum(c.cast("int")).alias(name)
    return met.groupBy("kind").agg(n(right, "correct"), n(~right & ~missed, "wrong"), n(missed, "missed")).withColumn("accuracy", ratio(F.col("correct"), F.col("correct") + F.col("wrong") + F.col("missed")))


def drop_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    return rows.groupBy(reason).agg(F.count("*").alias("n"))


def sampling_audit(rows: DataFrame, source: str, doc: str, draws: str, limits: dict[str, float]) -> DataFrame:
    """(source, draws, share, largest, limit, ok): shares of draws, and the largest single document's, against limits."""
    total = Window.partitionBy()
    per = rows.groupBy(source).agg(F.sum(draws).alias("draws"), F.max(draws).alias("largest"))
    shares = per.withColumn("share", F.round(F.col("draws") / F.sum("draws").over(total), 4))
    limit = F.coalesce(*[F.when(F.col(source) == k, v) for k, v in limits.items()], F.lit(1.0))
    return shares.withColumn("limit", limit).withColumn("ok", F.col("share") <= F.col("limit"))


def exposure(rows: DataFrame, batch: str, label: str, mass: str) -> DataFrame:
    """(label, share): the mean over batches of a label's share of the batch's mass."""
    of_batch = Window.partitionBy(batch)
    per = rows.groupBy(batch, label).agg(F.sum(mass).alias("m")).withColumn("share", F.col("m") / F.sum("m").over(of_batch))
    batches = per.agg(F.countDistinct(batch).alias("n"))
    return per.groupBy(label).agg(F.sum("share").alias("s")).crossJoin(F.broadcast(batches)).select(label, (F.col("s") / F.col("n")).alias("share"))


def learning_gate(rows: DataFrame, step: str, kind: str, recall: str, start: int, least: float) -> DataFrame:
    """(kind, passed): whether every recall from the start step on is enough."""
    return rows.where(F.col(step) >= start).groupBy(kind).agg(F.bool_and(F.col(recall) >= least).alias("passed"))


def class_weights(counts: DataFrame, label: str, n: str, outside: str = "O") -> DataFrame:
    """(label, weight): the root of how much rarer than outside a label is, at most 5."""
    base = counts.where(F.col(label) == outside).agg(F.sum(n).alias("base"))
    return counts.crossJoin(F.broadcast(base)).select(label, F.least(F.lit(5.0), F.sqrt(F.col("base") / F.col(n))).alias("weight"))


def worst(rows: DataFrame, wrong: str, confidence: str, id_col: str, n: int) -> DataFrame:
    """The n rows with most wrong characters, the least sure first."""
    return rows.orderBy(F.desc(wrong), F.asc(confidence), id_col).limit(n)
