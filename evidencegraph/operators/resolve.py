"""Entity resolution: key joins, name matches, the ordered registry, survivors and conflicts.

The registry folds mentions in the order of `seq`. Mentions of different blocks can't meet in it: a block is a connected
component of mentions that share a key or have names that may match. So the fold runs block by block, in parallel,
and ids follow from the order of the mentions that open an entity.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.similarity import SAME_NAME, SIMILAR_NAME, alignment, block_ratio, edit_ratio, jaccard
from ..tables import spread, written
from .graph import components
from .order import numbered

KEYS = ("phone", "wechat", "idcard", "account")
#: Keys that a match across modalities compares, under these names only.
ACROSS = ("phone", "account")
#: Confidence of a match by each key.
KEY_CONFIDENCE = {"phone": 1.0, "wechat": 1.0, "idcard": 0.95, "account": 0.9}
ALIASES = {
    "phone": ("phone", "phone_number"),
    "wechat": ("wechat", "wechat_id", "handle"),
    "idcard": ("id_card", "id_card_number", "idcard"),
    "account": ("account", "bank_account", "payment_account"),
    "name": ("name", "user_name"),
}


def with_keys(rows: DataFrame) -> DataFrame:
    """The first alias of each key that is there and not empty, normalised, as n_phone, n_wechat, n_idcard, n_account, n_name.

    Those of ACROSS that stand under the key's own name come as r_phone, r_account too.
    """
    of = {"phone": S.normalized_phone, "wechat": S.normalized_name, "idcard": S.normalized_idcard, "account": S.normalized_account, "name": S.normalized_name}
    none = F.lit(None).cast("string")
    rows = rows.withColumns({f"r_{k}": of[k](S.truthy(F.col(k).cast("string"))) if k in rows.columns else none for k in ACROSS})
    return rows.withColumns({f"n_{k}": of[k](F.coalesce(*[S.truthy(F.col(a).cast("string")) for a in ALIASES[k] if a in rows.columns], none)) for k in of})


def deterministic_matches(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """JOI-1: for each incoming row (with keys and `seq`) the entity of the first key that hits: matching_field, confidence.

    Each key is an equi-join of its own; an entity key held by several rows belongs to the one written last.
    """
    out = incoming
    for k in KEYS:
        held = registry.filter(F.col(f"n_{k}").isNotNull()).groupBy(F.col(f"n_{k}").alias("_key")).agg(F.max_by("entity_id", "seq").alias(f"_{k}"))
        out = out.join(held, out[f"n_{k}"] == F.col("_key"), "left").drop("_key")
    field = F.coalesce(*[F.when(F.col(f"_{k}").isNotNull(), F.lit(k)) for k in KEYS])
    confidence = F.coalesce(*[F.when(F.col(f"_{k}").isNotNull(), F.lit(KEY_CONFIDENCE[k])) for k in KEYS], F.lit(0.0))
    matched = out.withColumns({"matched_entity_id": F.coalesce(*[F.col(f"_{k}") for k in KEYS]), "matching_field": field, "match_confidence": confidence})
    return matched.drop(*[f"_{k}" for k in KEYS])


#: What a composite of SAME_NAME needs of the matching-block ratio, the other parts being whole; SIMILAR_NAME needs more.
LEAST_RATIO = 0.7


def name_pairs(left: DataFrame, right: DataFrame, key: str = "n_name") -> DataFrame:
    """Pairs a, b of different names among which are all with a matching-block ratio of LEAST_RATIO or more.

    Such names share LEAST_RATIO / 2 of their characters, counted with repeats, and the shorter has at least 0.538 of the longer's
    length. So each shares 0.538 of its own characters, and, with characters ordered from the rarest of all names, the
    first 0.462 and one more of both have one in common: pairs meet on these.
    """
    share = LEAST_RATIO / 2
    shorter = share / (1 - share)
    a = left.select(F.col(key).alias("a")).filter("a <> ''").distinct()
    b = right.select(F.col(key).alias("b")).filter("b <> ''").distinct()

    def characters(c: Column) -> Column:
        xs = F.split(c, "")
        return F.transform(xs, lambda x, i: F.concat(x, F.size(F.filter(F.slice(xs, 1, i + 1), lambda y: y == x)).cast("string")))

    seen = a.select(F.col("a").alias("x")).unionByName(b.select(F.col("b").alias("x"))).distinct()
    count = seen.select(F.explode(characters(F.col("x"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))

    def rarest(rows: DataFrame, c: str) -> DataFrame:
        grams = rows.select(c, F.explode(characters(F.col(c))).alias("gram")).join(count, "gram")
        rank = F.row_number().over(Window.partitionBy(c).orderBy("n", "gram"))
        return grams.withColumn("_rank", rank).filter(F.col("_rank") <= F.floor((1 - shorter) * F.length(c)) + 1).select(c, "gram")

    pairs = rarest(a, "a").join(rarest(b, "b"), "gram").filter("a <> b").select("a", "b").distinct()
    short, long = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    return pairs.filter(short >= (shorter - 1e-9) * long)


#: Edits of two names of a composite of SAME_NAME, at most, by the characters of the longer one: with k edits of n characters and m of the
#: other the matching-block ratio is 1 - k / (n + m) at most and the edit ratio 1 - k / n, so k (0.5 / (n + m) + 0.3 / n) is 0.15 at most.
EDITS = (3, 11)

#: The same for each pair of lengths. What is in no block is n + m less an even number, so it is one more than k edits where they differ by parity.
FITTING_EDITS = "10 * long * (d + (d + long - short) % 2) + 6 * d * (long + short) <= 3 * long * (long + short)"


def pair_marks(x: Column) -> tuple[Column, Column]:
    """Two words with a bit for the hash of each two characters in a row. An edit takes two of them from a name at most."""
    at = F.when(F.length(x) > 1, F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.pmod(F.xxhash64(F.substring(x, i, F.lit(2))), F.lit(128)).cast("int"))).otherwise(F.array().cast("array<int>"))
    one = F.lit(1).cast("long")
    word = lambda own: F.aggregate(F.filter(at, own), F.lit(0).cast("long"), lambda w, b: w.bitwiseOR(F.call_function("shiftleft", one, b % 64)))
    return word(lambda b: b < 64), word(lambda b: b >= 64)


def same_name_candidates(left: DataFrame, right: DataFrame, key: str = "n_name") -> DataFrame:
    """Pairs a, b of different names among which are all with a composite score of SAME_NAME or more.

    Of names with at most k edits, one cut in k + 1 segments has one, the i-th from 0 on, that stands in the other with i edits at most before
    and k - i after it; so it is moved by no more. Pairs meet on such segments, by both lengths, if their marks differ by no more than k
    edits make; those of more edits are let go. All of it runs inside Catalyst.
    """

    def marked(rows: DataFrame) -> DataFrame:
        # two tables, so that neither the names nor their marks are worked out again below
        x = written(spread(rows.select(F.col(key).alias("x")).filter("x <> ''"), "x").distinct(), "names")
        first, second = pair_marks(F.col("x"))
        return written(x.withColumns({"m0": first, "m1": second}), "marks")

    a = marked(left)
    b = a if left is right else marked(right)
    over, under = EDITS
    of = a.unionByName(b).select(F.length("x").alias("n")).distinct()
    lengths = of.select(F.col("n").alias("short")).join(of.select(F.col("n").alias("long")), F.expr(f"long between short and short * {under} div {under - over}"))
    lengths = lengths.withColumn("k", F.expr(f"array_max(filter(sequence(0, {over} * long div {under}), d -> {FITTING_EDITS}))")).filter("long - short <= k")
    lengths = written(lengths, "lengths")
    rest, base = F.expr("short % (k + 1)"), F.expr("short div (k + 1)")

    def begin(i: Column) -> Column:
        # the middle ones, which may have moved most, are the longer ones
        return (i * base + F.least(F.greatest(i - F.floor((F.col("k") + 1 - rest) / 2), F.lit(0)), rest)).cast("int")

    def cut(names: DataFrame, longer: bool, apart: bool = False) -> DataFrame:
        """key, x, marks, k: the segments of names as the shorter of two, or the places of the longer where they may stand."""
        own = "long" if longer else "short"
        rows = names.withColumn(own, F.length("x")).join(F.broadcast(lengths.filter("long > short") if apart else lengths), own)
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i")).withColumns({"at": begin(F.col("i")), "size": begin(F.col("i") + 1) - begin(F.col("i"))})
        if longer:
            shifts = F.expr("sequence(greatest(-i, long - short - k + i), least(i, long - short + k - i))")
            rows = rows.withColumn("shift", F.explode(shifts)).withColumn("at", (F.col("at") + F.col("shift")).cast("int")).filter("at >= 0 and at + size <= long")
        return rows.select(F.xxhash64("short", "long", "i", F.substring("x", F.col("at") + 1, F.col("size"))).alias("key"), "x", "m0", "m1", "k")

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        pairs = x.select("key", F.col("x").alias("a"), F.col("m0").alias("a0"), F.col("m1").alias("a1"), "k").join(y.select("key", F.col("x").alias("b"), F.col("m0").alias("b0"), F.col("m1").alias("b1")), "key")
        return pairs.filter("bit_count(a0 & ~b0) + bit_count(a1 & ~b1) <= 2 * k and bit_count(b0 & ~a0) + bit_count(b1 & ~a1) <= 2 * k and a <> b").select("a", "b")

    pairs = met(cut(a, False), cut(b, True)).unionByName(met(cut(a, True, True), cut(b, False, True))).distinct()  # names of one length meet in the first
    # a table, so that the join has no condition but that of the marks
    return written(pairs, "candidates").filter(F.levenshtein("a", "b") * under <= F.greatest(F.length("a"), F.length("b")) * over)


def same_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, score: pairs of different names with a composite score of SAME_NAME or more, of `a` against `b`."""
    a, b = F.col("a"), F.col("b")
    pairs = same_name_candidates(left, right).withColumn("_cheap", 0.3 * edit_ratio(a, b) + 0.2 * jaccard(a, b))
    most = 1 - F.levenshtein(a, b) / (F.length(a) + F.length(b))
    near = pairs.filter(0.5 * most + F.col("_cheap") >= SAME_NAME - 1e-9)  # before Python sees a pair
    return near.select("a", "b", (0.5 * block_ratio(a, b) + F.col("_cheap")).alias("score")).filter(F.col("score") >= SAME_NAME)


def fuzzy_matches(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """JOI-2: seq, matched_entity_id, score: the best composite score of SAME_NAME or more; the entity of the least seq wins ties."""
    scored = same_names(incoming, registry)
    same = incoming.join(registry.select("n_name"), "n_name", "left_semi").select(F.col("n_name").alias("a"), F.col("n_name").alias("b"), F.lit(1.0).alias("score")).filter("a <> ''").distinct()
    scored = scored.unionByName(same)
    named = registry.groupBy("n_name").agg(F.min(F.struct("seq", "entity_id")).alias("e"))
    best = scored.join(named, F.col("b") == F.col("n_name")).groupBy("a").agg(F.max(F.struct("score", (-F.col("e.seq")).alias("order"), F.col("e.entity_id").alias("entity_id"))).alias("m"))
    return incoming.join(best, F.col("n_name") == F.col("a")).select("seq", F.col("m.entity_id").alias("matched_entity_id"), F.col("m.score").alias("score"))


def aligned_pairs(a: DataFrame, b: DataFrame, block: str) -> DataFrame:
    """FN-14 over pairs that share `block`: seq_a, seq_b, score, level of those that align."""
    x = a.select(block, *[F.col(c).alias(f"a_{c}") for c in ("seq", "type", "name", "confidence", "source")])
    y = b.select(block, *[F.col(c).alias(f"b_{c}") for c in ("seq", "type", "name", "confidence", "source")])
    of = alignment(*[F.col(f"a_{c}") for c in ("type", "name", "confidence", "source")], *[F.col(f"b_{c}") for c in ("type", "name", "confidence", "source")])
    out = x.join(y, block).filter("a_seq < b_seq").withColumn("m", of)
    return out.select(F.col("a_seq").alias("seq_a"), F.col("b_seq").alias("seq_b"), F.round("m.score", 6).alias("score"), F.col("m.level").alias("level")).filter("level <> 'none'")


def fused(mentions: DataFrame) -> DataFrame:
    """JOI-5, AGG-3: one entity for each name; of the most confident mention, the first at ties; numbered by first mention.

    Its confidence is 1.2 times the mean, 1 at most.
    """
    name = F.trim(F.lower(F.coalesce("name", F.lit(""))))
    keyed = mentions.withColumn("_name", name).filter("_name <> ''")
    best = F.max_by(F.struct("name", "type"), F.struct("confidence", -F.col("seq")))
    out = keyed.groupBy("_name").agg(
        best.alias("best"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_sort(F.collect_list("uuid")).alias("uuids"),
        F.count("*").alias("mention_count"),
        F.least(F.lit(1.0), F.avg(F.coalesce("confidence", F.lit(0.5))) * 1.2).alias("confidence"),
        F.min("seq").alias("first_seq"),
    )
    return out.select(F.col("_name").alias("key"), "best.name", "best.type", "sources", "uuids", "mention_count", F.lit("deterministic").alias("match_level"), "confidence", "first_seq")


def survivors(rows: DataFrame, entity: str, attributes: list[str], seq: str = "seq") -> DataFrame:
    """AGG-1, order-free: the value of the highest confidence, the first one at ties, of each attribute; sources; merged_count."""
    best = [F.max_by(a, F.when(F.coalesce(F.col(a), F.lit("")) != "", F.struct("confidence", -F.col(seq)))).alias(a) for a in attributes]
    return rows.groupBy(entity).agg(*best, F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("merged_count"))


def conflicts(rows: DataFrame, entity: str, attributes: list[str], seq: str = "seq") -> DataFrame:
    """AGG-2, GRA-10, order-free: each value of an attribute that differs from the one that survives: existing, new, resolved, strategy."""
    long = rows.select(entity, seq, "confidence", F.explode(F.create_map(*[x for a in attributes for x in (F.lit(a), F.col(a))])).alias("attribute", "value")).filter("value <> ''")
    w = Window.partitionBy(entity, "attribute").orderBy(F.col("confidence").desc(), seq)
    kept = long.withColumns({"resolved": F.first("value").over(w), "kept_confidence": F.first("confidence").over(w)}).filter("value <> resolved")
    strategy = resolution(F.col("resolved"), F.col("value"), F.col("kept_confidence"), F.col("confidence"))["strategy"]
    return kept.select(entity, "attribute", F.col("value").alias("rejected"), "resolved", strategy.alias("strategy")).distinct()


def resolution(existing: Column, new: Column, existing_confidence: Column, new_confidence: Column) -> Column:
    """AGG-2: struct resolved, confidence, strategy of two values."""
    made = lambda v, c, s: F.struct(v.alias("resolved"), c.alias("confidence"), F.lit(s).alias("strategy"))
    return (
        F.when(existing == new, made(existing, F.greatest(existing_confidence, new_confidence), "identical"))
        .when(new_confidence > existing_confidence, made(new, new_confidence, "new_value"))
        .otherwise(made(existing, existing_confidence, "existing_value"))
    )


def running_confidence(rows: DataFrame, entity: str, seq: str, alpha: float = 0.3) -> DataFrame:
    """AGG-1: the confidence after each mention has moved it by `alpha` towards its own."""
    listed = F.array_sort(F.collect_list(F.struct(seq, "confidence")))
    moved = F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))), F.col("xs")[0]["confidence"], lambda c, x: alpha * x["confidence"] + (1 - alpha) * c)
    return rows.groupBy(entity).agg(listed.alias("xs")).select(entity, F.size("xs").cast("long").alias("mentions"), F.round(moved, 6).alias("confidence"))


def _composite(a: str, b: str) -> float:
    longer = max(len(a), len(b))
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, old = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
    x, y = set(a), set(b)
    return 0.5 * SequenceMatcher(None, a, b).ratio() + 0.3 * (1 - row[-1] / longer if longer else 0) + 0.2 * (len(x & y) / len(x | y) if x | y else 0)


class Registry:
    """JOI-1 to JOI-4, AGG-1 in order, over one block."""

    def __init__(self) -> None:
        self.entities: list[dict] = []
        self.held: dict[str, dict[str, int]] = {k: {} for k in (*KEYS, "name")}
        self.order: dict[str, int] = {}
        self.log: list[tuple] = []

    def add(self, m: dict) -> None:
        level, at, confidence, field = self._match(m)
        if at is None:
            at = len(self.entities)
            self.entities.append({"values": {k: m[k] for k in (*KEYS, "name")}, "across": self._across(m), "confidence": m["confidence"], "sources": [m["source"]], "count": 1, "seq": m["seq"], "conflicts": []})
            # a key that a later merge brings is not looked up
            for k in self.held:
                if m[k]:
                    self.held[k][m[k]] = at
            if m["name"]:
                self.order.setdefault(m["name"], len(self.order))
            level, confidence, field = 0, 1.0, None
        else:
            self._merge(self.entities[at], m)
        self.log.append((m["seq"], at, level, confidence, field))

    def _match(self, m: dict) -> tuple[int, int | None, float, str | None]:
        for k in KEYS:
            if m[k] and m[k] in self.held[k]:
                return 1, self.held[k][m[k]], KEY_CONFIDENCE[k], k
        best, score = None, 0.0
        if m["name"]:
            # `near`, where given, has all names of a score of SAME_NAME or more
            known = m.get("near")
            for name, at in self.held["name"].items() if known is None else self._held_of(m["name"], known):
                if (s := _composite(m["name"], name) if known is None else known.get(name, 1.0)) > score:
                    best, score = at, s
            if best is not None and score >= SAME_NAME:
                return 2, best, score, "name"
            best, score = None, 0.0
            for at, e in enumerate(self.entities):
                if not e["values"]["name"]:
                    continue
                own = self._across(m)
                both = [k for k in ACROSS if own[k] and e["across"][k]]
                equal = sum(own[k] == e["across"][k] for k in both)
                if not equal:
                    continue  # a score of 0.6 at most
                near = SequenceMatcher(None, m["name"], e["values"]["name"]).ratio()
                if near >= SIMILAR_NAME:
                    s = 0.6 * near + 0.4 * equal / len(both)
                    if s > score:
                        best, score = at, s
            if best is not None and score >= SIMILAR_NAME:
                return 3, best, score, "cross_modal"
        return 0, None, 1.0, None

    def _held_of(self, own: str, known: dict[str, float]) -> list[tuple[str, int]]:
        """Names that are held of `own` and those known to be near it, in the order in which they were first held."""
        held = self.held["name"]
        return [(n, held[n]) for n in sorted((n for n in (own, *known) if n in held), key=self.order.__getitem__)]

    @staticmethod
    def _across(m: dict) -> dict:
        return {k: m.get(f"raw_{k}", m[k]) for k in ACROSS}

    @staticmethod
    def _merge(e: dict, m: dict) -> None:
        own = e["confidence"]
        for k, new in Registry._across(m).items():
            if new and (not e["across"][k] or m["confidence"] > own):
                e["across"][k] = new
        for k in (*KEYS, "name"):
            old, new = e["values"][k], m[k]
            if not old and new:
                e["values"][k] = new
            elif old and new != old:
                takes = m["confidence"] > own
                e["conflicts"].append((k, old, new, new if takes else old, "new_value" if takes else "existing_value"))
                if takes:
                    e["values"][k] = new
        # the confidence is an attribute too, of which the higher value wins before it moves
        own = max(own, m["confidence"])
        e["confidence"] = 0.3 * m["confidence"] + 0.7 * own
        e["count"] += 1
        if m["source"] not in e["sources"]:
            e["sources"].append(m["source"])


def blocks(mentions: DataFrame) -> DataFrame:
    """`mentions` with `block`, and the names near theirs with the scores: those of different blocks share no key, and no names of a composite score of SAME_NAME.

    A match across modalities needs an equal key, so it stays inside a block.
    """
    keyed = with_keys(spread(mentions, "seq"))
    keyed = written(keyed.select("seq", "confidence", "source", *[f"n_{k}" for k in (*KEYS, "name")], *[f"r_{k}" for k in ACROSS]), "keyed")
    links = None
    for k in (*KEYS, "name"):
        held = keyed.filter(F.col(f"n_{k}") != "").select("seq", F.col(f"n_{k}").alias("v"))
        own = held.groupBy("v").agg(F.min("seq").alias("root"))
        part = held.join(own, "v").select(F.col("seq").alias("a"), F.col("root").alias("b"))
        links = part if links is None else links.unionByName(part)
    near = written(same_names(keyed, keyed), "same-names")
    first = keyed.filter("n_name <> ''").groupBy("n_name").agg(F.min("seq").alias("root"))
    similar = near.join(first.select(F.col("n_name").alias("a"), F.col("root").alias("ra")), "a").join(first.select(F.col("n_name").alias("b"), F.col("root").alias("rb")), "b")
    links = links.unionByName(similar.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    roots = components(links.filter("a <> b").select("a", "b"))
    listed = near.groupBy(F.col("a").alias("n_name")).agg(F.collect_list("b").alias("near_names"), F.collect_list("score").alias("near_scores"))
    out = keyed.join(roots.select(F.col("node").alias("seq"), F.col("component").alias("_c")), "seq", "left").withColumn("block", F.coalesce("_c", "seq")).drop("_c")
    return out.join(listed, "n_name", "left")


def resolve_in_order(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ordered registry over mentions (seq, confidence, source, and keys): its entities, and seq, entity_id, match_level, match_confidence, matching_field.

    A block is folded in one task; blocks are as large as chains of similar names make them, while `resolve_as_set` has no such bound.
    """
    fields = "block long, seq long, at int, level int, score double, field string, opened long, name string, phone string, wechat string, idcard string, account string, confidence double, sources array<string>, merged_count long, n_conflicts long"
    keyed = blocks(mentions)

    def folded(block: int, r: Registry) -> list[tuple]:
        rows = []
        for seq, at, level, score, field in r.log:
            e = r.entities[at]
            v = e["values"]
            rows.append((block, seq, at, level, score, field, e["seq"], v["name"], v["phone"], v["wechat"], v["idcard"], v["account"], e["confidence"], e["sources"], e["count"], len(e["conflicts"])))
        return rows

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Block after block: rows come in their order."""
        names = [f.split()[0] for f in fields.split(", ")]
        block, r = None, Registry()
        for pdf in frames:
            rows: list[tuple] = []
            for row in pdf.itertuples(index=False):
                if row.block != block:
                    rows += folded(block, r)
                    block, r = row.block, Registry()
                r.add({**{k: getattr(row, f"n_{k}") or None for k in (*KEYS, "name")}, **{f"raw_{k}": getattr(row, f"r_{k}") or None for k in ACROSS}, "seq": row.seq, "confidence": 1.0 if pd.isna(row.confidence) else row.confidence, "source": row.source or "unknown", "near": {} if row.near_names is None else dict(zip(row.near_names, row.near_scores, strict=True))})
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame(folded(block, r), columns=names)

    wanted = keyed.select("block", "seq", "confidence", "source", *[f"n_{k}" for k in (*KEYS, "name")], *[f"r_{k}" for k in ACROSS], "near_names", "near_scores")
    done = written(wanted.repartition("block").sortWithinPartitions("block", "seq").mapInPandas(fold, fields), "folded")
    opened = done.filter("level = 0").select("opened")
    ids = numbered(opened, "opened").select("opened", F.format_string("ENTITY_%06d", F.col("number") + 1).alias("entity_id"))
    done = done.join(ids, "opened")
    entities = done.filter("level = 0").select("entity_id", F.col("opened").alias("seq"), "name", "phone", "wechat", "idcard", "account", F.round("confidence", 6).alias("confidence"), F.array_sort("sources").alias("sources"), "merged_count", "n_conflicts")
    return entities, done.select("seq", "entity_id", F.col("level").alias("match_level"), F.round("score", 6).alias("match_confidence"), F.col("field").alias("matching_field"))


def resolve_as_set(mentions: DataFrame) -> DataFrame:
    """seq, entity (its smallest seq) of mentions that keys connect, whatever their order; it scales to any chain of keys."""
    keyed = with_keys(mentions)
    links = None
    for k in KEYS:
        held = keyed.filter(F.col(f"n_{k}") != "").select("seq", F.col(f"n_{k}").alias("v"))
        part = held.join(held.groupBy("v").agg(F.min("seq").alias("b")), "v").select(F.col("seq").alias("a"), "b")
        links = part if links is None else links.unionByName(part)
    roots = components(links.filter("a <> b").select("a", "b"))
    return keyed.join(roots, F.col("seq") == F.col("node"), "left").select("seq", F.coalesce("component", "seq").alias("entity"))


def lookup(registry: DataFrame, entity_id: str | None = None, phone: str | None = None, name: str | None = None) -> DataFrame:
    """FIL-10: entities of an id, a phone or a name, normalised as they are; of those that are given all must fit."""
    wanted = {"entity_id": F.lit(entity_id), "n_phone": S.normalized_phone(F.lit(phone)), "n_name": S.normalized_name(F.lit(name))}
    for (column, value), given in zip(wanted.items(), (entity_id, phone, name), strict=True):
        if given is not None:
            registry = registry.filter(F.col(column) == value)
    return registry


def created(records: DataFrame, registry: DataFrame) -> DataFrame:
    """JOI-10: seq, entity_id, ts of what `integrated` records add to the registry, as timeline events.

    Records of one phone are one entity, a record without one is its own; ids go on after the registry's, in the order of seq.
    """
    own = integrated(records, registry).filter("not matched").withColumn("_p", S.truthy(S.normalized_phone("phone")))
    opened = own.withColumn("_k", F.coalesce("_p", F.concat(F.lit("seq "), F.col("seq").cast("string"))))
    first = numbered(opened.groupBy("_k").agg(F.min("seq").alias("_first")), "_first")
    held = F.broadcast(registry.agg(F.count("*").alias("_held")))  # one row
    ids = first.join(held).select("_k", F.format_string("ENTITY_%06d", F.col("_held") + F.col("number") + 1).alias("_new"))
    return opened.join(ids, "_k").select("seq", F.col("_new").alias("entity_id"), *[c for c in ("ts",) if c in records.columns], F.lit("external_activity").alias("event_type"))


def integrated(records: DataFrame, registry: DataFrame) -> DataFrame:
    """JOI-10: for each external record the entity with its phone, or a new one: matched, entity_id, counterparty_id, weight."""
    phones = registry.filter("n_phone <> ''").groupBy("n_phone").agg(F.max_by("entity_id", "seq").alias("entity_id"))
    own = records.withColumns({"_p": S.normalized_phone("phone"), "_q": S.normalized_phone("counterparty_phone")})
    a = own.join(phones.select(F.col("n_phone").alias("_p"), "entity_id"), "_p", "left")
    b = a.join(phones.select(F.col("n_phone").alias("_q"), F.col("entity_id").alias("counterparty_id")), "_q", "left")
    return b.withColumns({"matched": F.col("entity_id").isNotNull(), "weight": F.coalesce("weight", F.lit(1.0))}).drop("_p", "_q")


def registry_statistics(registry: DataFrame) -> DataFrame:
    """AGG-10: totals, distinct keys, mean merged_count."""
    return registry.agg(
        F.count("*").alias("total_entities"),
        *[F.count_distinct(S.truthy(F.col(f"n_{k}"))).alias(f"{k}_indexed") for k in (*KEYS, "name")],
        F.round(F.avg("merged_count"), 6).alias("avg_merged_count"),
    )
