"""Pseudonyms: typed spans, greedy choice among overlaps, keyed tags in the text, and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..functions.scalars import keyed_tag
from ..tables import written

# Surnames, words of addresses and of contexts, and patterns by kind in order of priority.
SURNAMES = frozenset(
    "王李张刘陈杨黄赵周吴" "徐孙马朱胡郭何高林罗" "郑梁谢宋唐许韩冯邓曹" "彭曾肖田董袁潘于蒋蔡" "余杜叶程苏魏吕丁任沈"
    "姚卢姜崔钟谭陆汪范金" "石廖贾夏韦付方白邹孟" "熊秦邱江尹薛闫段雷侯" "龙史陶黎贺顾毛郝龚邵" "万钱严覃武戴莫孔向汤"
)
ADDRESS_WORDS = ("省", "市", "区", "县", "镇", "乡", "村", "街道", "路", "号", "小区", "栋", "单元", "室", "楼", "层", "弄", "巷", "里", "庄")
NUMBER_WORDS = ("订单", "编号", "流水", "单号", "ID", "序号")
DOSAGE_WORDS = ("片", "胶囊", "颗粒", "丸", "注射液", "口服液")
PATTERNS = {
    "phone": r"\b1[3-9]\d{9}\b",
    "id_card": r"\b\d{15}(\d{2}[0-9Xx])?\b",
    "email": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
    "url": r"https?://[^\s]+",
    "address": r"[一-龥]{2,}(?:省|市|区|县|镇|乡|村|街道|路|号|小区|栋|单元|室|楼|层)[^\s，。！？;；]*",
    "chinese_name": r"[一-龥]{2,4}",
    "wechat": r"\b[a-zA-Z][a-zA-Z0-9_\-]{3,20}\b",
    "long_number": r"\b\d{10,}\b",
}
SPAN = "array<struct<start:int,end:int,kind:string,raw:string>>"

_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}


def likely_name(text: str) -> bool:
    """FN-20: two to four characters, a known surname first, no word of an address."""
    return 2 <= len(text) <= 4 and text[0] in SURNAMES and not any(w in text for w in ADDRESS_WORDS)


def _vetoed(kind: str, text: str, start: int, end: int) -> bool:
    """FN-21: what stands around a match speaks against it."""
    near = {"long_number": (20, 20, NUMBER_WORDS), "wechat": (20, 0, ("http", "://")), "chinese_name": (0, 5, DOSAGE_WORDS)}.get(kind)
    if near is None:
        return False
    before, after, words = near
    # both sides are read as one text
    around = text[max(0, start - before) : start] + text[end : end + after]
    return any(w in around for w in words)


def candidates(text: str, context: bool = True) -> list[tuple[int, int, str, str]]:
    """PSE-2: spans of all kinds, in order of priority."""
    out = []
    for kind, pattern in _COMPILED.items():
        for m in pattern.finditer(text):
            if (context and _vetoed(kind, text, *m.span())) or (kind == "chinese_name" and not likely_name(m.group())):
                continue
            out.append((m.start(), m.end(), kind, m.group()))
    return out


#: Bytes of text whose spans are made at a time.
PIECE = 256 << 10
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("raw", pa.string())])


def spans_of(texts: list[str]) -> pa.ListArray:
    """The candidates of each text, column by column."""
    ends, start, end, kind, raw = [0], [], [], [], []
    for text in texts:
        for a, b, k, r in candidates(text or ""):
            start.append(a)
            end.append(b)
            kind.append(k)
            raw.append(r)
        ends.append(len(start))
    spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(kind, pa.string()), pa.array(raw, pa.string())], fields=list(_SPAN))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)


def with_candidates(rows: DataFrame, text: str, name: str) -> DataFrame:
    """`rows` with the candidates of `text` as `name`: offsets of matches are beyond the built-in functions.

    Nearly each word is a span, so a batch of texts is worked on in pieces of PIECE bytes, which go back one by one.
    """
    at = rows.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
            begin = 0
            while begin < len(size):
                end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + PIECE, "right")))
                piece = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*piece.columns, spans_of(piece.column(at).to_pylist())], names=[*batch.schema.names, name])
                begin = end

    return rows.mapInArrow(work, StructType([*rows.schema, StructField(name, DataType.fromDDL(SPAN))]))


def resolved(spans: Column) -> Column:
    """PSE-3: of spans by start and falling length those that begin where the last one kept has ended; ties by order of priority."""
    rank = F.array(*map(F.lit, PATTERNS))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("less"), F.array_position(rank, s["kind"]).alias("rank"), s.alias("span")))
    start = F.struct(F.lit(-1).alias("end"), F.array().cast(SPAN).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = x["start"] >= acc["end"]
        return F.struct(F.when(fits, x["span"]["end"]).otherwise(acc["end"]).alias("end"), F.when(fits, F.concat(acc["kept"], F.array(x["span"]))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(F.array_sort(keyed), start, step, lambda acc: acc["kept"])


def rewritten(text: Column, kept: Column, salt: str) -> Column:
    """PSE-4: each span kept becomes its tag."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, keyed_tag(F.upper(s["kind"]), s["raw"], salt)).alias("out"))

    return F.aggregate(kept, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def pseudonymized(rows: DataFrame, salt: str, text: str = "content", seq: str | None = None) -> DataFrame:
    """PSE-7, PSE-9: `rows` with `text` rewritten, `spans` (kept) and `nested` (number of spans that overlaps cost).

    With `seq`, which names rows and orders them, a value has the tag of the kind it is first seen with, as `mapping` has it;
    without, that of the kind it has where it stands.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = with_candidates(rows, text, "_found").withColumn("spans", resolved(F.col("_found")))
    out = out.withColumn("nested", F.size("_found") - F.size("spans")).drop("_found")
    if seq is None:
        return out.withColumn(text, rewritten(body, F.col("spans"), salt))
    out = written(out, "spans")
    several = first_kinds(out, seq).filter("several").select("raw", F.col("kind").alias("first"))
    own = out.select(seq, F.explode("spans").alias("s")).select(seq, F.col("s.raw").alias("raw")).distinct().join(several, "raw")
    kinds = own.groupBy(seq).agg(F.map_from_entries(F.collect_list(F.struct("raw", "first"))).alias("_kinds"))
    tagged = F.transform("spans", lambda s: s.withField("kind", F.coalesce(F.try_element_at("_kinds", s["raw"]), s["kind"])))
    return out.join(kinds, seq, "left").withColumn(text, rewritten(body, tagged, salt)).drop("_kinds")


def first_kinds(rows: DataFrame, seq: str) -> DataFrame:
    """raw, kind, several: each value with the kind it is first seen with, and whether it has others."""
    each = rows.select(seq, F.explode("spans").alias("s")).select(F.col("s.raw").alias("raw"), F.col("s.kind").alias("kind"), F.struct(F.col(seq), -F.col("s.start")).alias("at"))
    return each.groupBy("raw").agg(F.min_by("kind", "at").alias("kind"), (F.min("kind") != F.max("kind")).alias("several"))


def mapping(rows: DataFrame, salt: str, seq: str) -> DataFrame:
    """PSE-5, SNK-7: raw, kind, pseudonym of all kept spans of `pseudonymized` rows.

    A raw value has the kind it is first seen with: by `seq`, and in a text from its end.
    """
    return first_kinds(rows, seq).drop("several").withColumn("pseudonym", keyed_tag(F.upper("kind"), F.col("raw"), salt))


def statistics(rows: DataFrame, found: DataFrame, text: str = "content") -> DataFrame:
    """PSE-8: total_processed and nested_cases, and a row of counts by kind."""
    total = rows.agg(F.count_if(F.coalesce(F.col(text), F.lit("")) != "").alias("total_processed"), F.coalesce(F.sum("nested"), F.lit(0)).alias("nested_cases"))
    kinds = found.groupBy("kind").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("entities_found"))
    return total.join(kinds)


def restored(rows: DataFrame, pairs: DataFrame, key: str, text: str = "content") -> DataFrame:
    """PSE-6: tags of `pairs` (pseudonym, raw) in `text` turned back, wherever they stand."""
    tag = r"\b(?:" + "|".join(PATTERNS).upper() + r")_[0-9a-f]{10}\b"
    used = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({tag})")))).alias("pseudonym"))
    known = used.join(pairs.select("pseudonym", "raw"), "pseudonym").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pseudonym", "raw"))).alias("_pairs"))
    back = F.aggregate("_pairs", F.col(text), lambda t, p: F.replace(t, p["pseudonym"], p["raw"]))
    return rows.join(known, key, "left").withColumn(text, F.when(F.col("_pairs").isNull(), F.col(text)).otherwise(back)).drop("_pairs")
