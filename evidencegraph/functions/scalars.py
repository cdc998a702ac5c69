"""Column functions: times, keys, text rules, scores and bands. All run inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words, codes and bounds that results depend on.
DRUGS = (
    "amoxicillin", "ibuprofen", "paracetamol", "aspirin", "panadol",
    "cephalexin", "metformin", "atorvastatin", "amlodipine", "omeprazole",
    "losartan", "metoprolol", "gabapentin", "sertraline", "escitalopram",
    "fluoxetine", "prednisone", "azithromycin", "ciprofloxacin", "doxycycline",
)
NOT_PERSONS = ("CNY", "USD", "Transfer", "Red", "Envelope")
MIME_TYPES = {"wav": "audio/wav", "mp3": "audio/mpeg", "m4a": "audio/m4a", "aac": "audio/aac", "flac": "audio/flac", "ogg": "audio/ogg"}
DEFAULT_MIME = "audio/wav"
TYPE_CODES = {"1": "text", "3": "image", "34": "voice", "43": "video", "47": "emoji", "49": "link"}
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp")
VOICE_EXTENSIONS = (".mp3", ".wav", ".m4a", ".amr", ".aac")
QUALITY_BANDS = (("excellent", 0.9), ("good", 0.7), ("fair", 0.5))
EPOCH_MILLIS_FROM = 10_000_000_000
STAMP = "yyyy-MM-dd HH:mm:ss"

LOWER_AZ = "abcdefghijklmnopqrstuvwxyz"


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        found = found | F.contains(text, F.lit(p))
    return found


def truthy(c: Column) -> Column:
    """The string where it is neither null nor empty, else null."""
    return F.when(c != "", c)


def first_truthy(*columns: Column) -> Column:
    return F.coalesce(*map(truthy, columns))


def stripped(c: Column) -> Column:
    """Without white space of any alphabet at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def normalized_time(raw: Column) -> Column:
    """FN-1: epoch seconds and milliseconds in UTC, or ISO text in its own zone, as `yyyy-MM-dd HH:mm:ss`; what is neither stays as it is, null and empty are empty."""
    digits = F.rlike(raw, F.lit("^[0-9]{1,18}$"))
    number = F.try_to_number(raw, F.lit("999999999999999999")).cast("long")
    seconds = F.when(number > EPOCH_MILLIS_FROM, F.floor(number / 1000)).otherwise(number)
    pattern = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)?)((?<=:.{2,12})(?:Z|[+-][0-9]{2}(?::?[0-9]{2}(?::?[0-9]{2})?)?))?$"
    local = F.when(F.rlike(raw, F.lit(pattern)), F.regexp_extract(raw, pattern, 1))  # the zone is dropped: a time is shown as it was written
    parsed = F.when(digits, F.timestamp_seconds(seconds)).otherwise(F.try_to_timestamp(local))
    return F.when(F.coalesce(raw, F.lit("")) == "", "").otherwise(F.coalesce(F.date_format(parsed, STAMP), raw))


def voice_duration(content: Column) -> Column:
    """FN-2: whole seconds of `voiceLength`, from JSON between braces, else from the text; 0 if there is none."""
    braces = F.rlike(content, F.lit(r"(?s)\{.*\}"))
    of_json = F.get_json_object(F.regexp_extract(content, r"(?s)\{.*\}", 0), "$.voiceLength")
    of_text = F.regexp_extract(content, r"""voiceLength["']?\s*:\s*["']?([0-9]+)""", 1)
    return F.coalesce(F.when(braces, of_json).otherwise(truthy(of_text)).try_cast("int"), F.lit(0))


def normalized_phone(c: Column) -> Column:
    """FN-3: digits, the last 11 of them."""
    return F.right(F.regexp_replace(c, r"(?U)\D", ""), F.lit(11))


def normalized_name(c: Column) -> Column:
    """FN-4: also for handles."""
    return F.lower(stripped(c))


def normalized_idcard(c: Column) -> Column:
    """FN-5."""
    return F.upper(F.regexp_replace(c, r"(?U)\s+", ""))


def normalized_account(c: Column) -> Column:
    """FN-6."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """FN-9: edits by characters of the reference; it may exceed 1. Against an empty reference 1 or 0."""
    ref, hyp = F.coalesce(reference, F.lit("")), F.coalesce(hypothesis, F.lit(""))
    return F.when(ref == "", F.when(hyp == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(ref, hyp) / F.length(ref))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """FN-8, FN-10: edits by words. Each row's distinct words, of which there can be 1,048,575, become one character each, and characters are compared."""
    ref, hyp = tokens(reference), tokens(hypothesis)
    known = F.array_distinct(F.concat(ref, hyp))
    known = F.when(F.size(known) < 1 << 20, known).otherwise(F.raise_error(F.lit("a text has too many distinct words")).cast("array<string>"))
    wide = lambda ws: F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex((F.array_position(known, w) + 0xFFFF).cast("long")), 8, "0")), "UTF-32")), "")
    distance = F.levenshtein(wide(ref), wide(hyp))
    return F.when(F.size(ref) == 0, F.when(F.size(hyp) == 0, 0.0).otherwise(1.0)).otherwise(distance / F.size(ref))


def behavior(content: Column, sender: Column, receiver: Column) -> Column:
    """FN-15: struct type, normalized, amount, status, duration, target by the first rule that fits."""
    low = F.lower(content)
    has = lambda *p: _any(low, p)
    amount = F.coalesce(truthy(F.regexp_extract(content, r"([0-9]+(?:\.[0-9]+)?)", 1)), F.lit("0"))
    seconds = F.coalesce(truthy(F.regexp_extract(content, r"([0-9]+)\s*秒", 1)), F.lit("0"))
    paid = F.when(has("received", "yishoukuank"), "received").when(has("returned"), "returned").otherwise("pending")
    opened = F.when(has("expired"), "expired").otherwise("opened")
    place = F.coalesce(truthy(F.regexp_extract(content, r"([^\s]{2,})", 1)), F.lit("unknown"))
    none = F.lit(None).cast("string")

    def made(kind: str, text: Column, amount=none, status=none, duration=none, target=none) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("normalized"), amount.alias("amount"), status.alias("status"), duration.alias("duration"), target.alias("target"))

    money = lambda kind, status: F.concat(F.lit(f"{kind}: "), amount, F.lit(" CNY from "), sender, F.lit(" to "), receiver, F.lit(", "), status)
    call = lambda kind: F.concat(F.lit(f"{kind}: "), seconds, F.lit(" s between "), sender, F.lit(" and "), receiver)
    return (
        F.when(has("transfer", "zhuanzhang"), made("transfer", money("transfer", paid), amount, paid, target=receiver))
        .when(has("red envelope", "hongbao"), made("red_envelope", money("red_envelope", opened), amount, opened))
        .when(has("voice call", "yuyin"), made("call_voice", call("call_voice"), duration=seconds))
        .when(has("video call", "shipin"), made("call_video", call("call_video"), duration=seconds))
        .when(has("add friend", "tianjiahaoyou"), made("add_contact", F.concat(F.lit("add_contact: @"), receiver), target=receiver))
        .when(has("location", "weizhi"), made("location", F.concat(F.lit("location: "), place), target=place))
        .otherwise(made("message", F.substring(content, 1, 200)))
    )


def drug_mentions(content: Column) -> Column:
    """FN-16: array of (name, quantity): dictionary words in the text, in the dictionary's order, with the first quantity in the whole text."""
    low = F.lower(content)
    quantity = F.coalesce(truthy(F.regexp_extract(low, r"([0-9]+)\s*(?:mg|boxes?|pieces?|tablets?)", 0)), F.lit("unknown"))
    found = F.filter(F.array(*map(F.lit, DRUGS)), lambda d: F.contains(low, d))
    return F.transform(found, lambda d: F.struct(F.initcap(d).alias("name"), quantity.alias("quantity")))


def person_tokens(content: Column) -> Column:
    """FN-17: tokens of 2 to 4 Han characters, or of more than one character with a capital first; repeats stay."""
    han = lambda w: F.rlike(w, F.lit(r"^[\x{4e00}-\x{9fa5}]{2,4}$"))
    capital = lambda w: F.rlike(w, F.lit(r"^\p{Lu}.")) & (F.length(w) > 1)
    return F.filter(tokens(content), lambda w: (han(w) | capital(w)) & ~w.isin(*NOT_PERSONS))


def salvaged_json(text: Column) -> Column:
    """FN-18: what stands between the first and the last brace, if it is there."""
    return truthy(F.regexp_extract(text, r"(?s)\{.*\}", 0))


def keyed_tag(kind: Column, raw: Column, salt: str) -> Column:
    """FN-19: KIND_ and the first 10 hex digits of the HMAC-SHA256 of `raw`."""
    import hashlib

    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(raw, "UTF-8")), 256))), 256)
    return F.concat(kind, F.lit("_"), F.substring(digest, 1, 10))


def voice_quality(text: Column) -> Column:
    """FN-22: struct quality_score, completeness, value_level, recommendation, by the length of a transcript."""
    n = F.length(F.coalesce(text, F.lit("")))
    score = F.when(n == 0, 0.0).when(n < 10, 0.3).when(n < 50, 0.6).otherwise(0.8)
    level = F.when(n == 0, "invalid").when(n < 10, "poor").when(n < 50, "fair").otherwise("good")
    return F.struct(
        score.alias("quality_score"),
        level.alias("completeness"),
        F.when(score >= 0.6, "medium").otherwise("low").alias("value_level"),
        F.when(score < 0.7, "manual review").otherwise("usable").alias("recommendation"),
    )


def completeness(score: Column) -> Column:
    """FN-23."""
    return F.when(score > 0.6, "good").otherwise("poor")


def image_quality(confidence: Column, ocr_length: Column, n_entities: Column) -> Column:
    """FN-24: struct quality_score, reliability, usable: three parts, weighted, and how far they stray from the weighted score."""
    parts = (confidence, F.least(ocr_length / 100, F.lit(1.0)), F.least(n_entities / 5, F.lit(1.0)))
    score = 0.5 * parts[0] + 0.3 * parts[1] + 0.2 * parts[2]
    spread = ((parts[0] - score) * (parts[0] - score) + (parts[1] - score) * (parts[1] - score) + (parts[2] - score) * (parts[2] - score)) / 3
    reliability = 1 - F.least(spread, F.lit(0.3))
    final = score * reliability
    return F.struct(F.least(final, F.lit(1.0)).alias("quality_score"), reliability.alias("reliability"), (final >= 0.6).alias("usable"))


def image_category(reply: Column) -> Column:
    """FN-25."""
    low = F.lower(reply)
    return F.when(F.contains(low, F.lit("drug_box")), "drug_box").when(F.contains(low, F.lit("drug_list")), "drug_list").otherwise("other")


def drug_related(reply: Column, failed: Column) -> Column:
    """FN-26: struct category, confidence of a single reply; a failed call is normal, 0."""
    hit = ~failed & F.contains(F.lower(reply), F.lit("drug"))
    return F.struct(F.when(hit, "drug_related").otherwise("normal").alias("category"), F.when(failed, 0.0).otherwise(0.7).alias("confidence"))


def validated(drugs: Column, entities: Column) -> Column:
    """FN-27: of two JSON texts: both are objects, and entities that tell of drugs have some if there are drugs."""
    kind = lambda c: F.coalesce(F.schema_of_variant(c), F.lit("VOID"))
    d, e = F.try_parse_json(drugs), F.try_parse_json(entities)
    told = F.try_variant_get(e, "$.drugs", "variant")
    named = F.array_contains(F.map_keys(F.try_variant_get(e, "$", "map<string,variant>")), "drugs")
    none = kind(told).isin("VOID", "ARRAY<VOID>", "OBJECT<>") | F.coalesce(F.try_variant_get(told, "$", "string") == "", F.lit(False))
    objects = kind(d).startswith("OBJECT") & kind(e).startswith("OBJECT")
    return objects & ~((kind(d) != "OBJECT<>") & F.coalesce(named, F.lit(False)) & none)


def text_confidence(has_drugs: Column, has_entities: Column, valid: Column) -> Column:
    """FN-28."""
    number = lambda c, x: F.when(c, x).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 + number(has_drugs, 0.2) + number(has_entities, 0.1) + number(valid, 0.2))


def extraction_quality(fields: Column) -> Column:
    """FN-29: of a map of extracted fields: half a point, more for entries and for values that aren't empty."""
    filled = F.size(F.filter(F.map_values(fields), lambda v: F.coalesce(v, F.lit("")) != ""))
    many = F.when(F.size(fields) >= 3, 0.1).otherwise(0.0)
    return F.when(F.coalesce(F.size(fields), F.lit(0)) < 1, 0.0).otherwise(F.least(F.lit(1.0), 0.5 + 0.2 + many + 0.05 * filled))


def quality_level(score: Column) -> Column:
    """FN-30."""
    out = None
    for name, least in QUALITY_BANDS:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("poor")


def confidence_level(confidence: Column) -> Column:
    """FN-31: high, medium, low; null where it is no number of 0 to 1."""
    return F.when(confidence.between(0, 1), F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low"))


def mime_type(path: Column) -> Column:
    """FN-32: by the ending of a path."""
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.substring_index(path, ".", -1))), F.lit(DEFAULT_MIME))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1_scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """FN-36: precision, recall and f1, each rounded to 4 digits."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(ratio(2 * p * r, p + r), 4)}


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a time, with a zone or without."""
    return F.unix_micros(t.cast("timestamp"))


def hours_apart(a: Column, b: Column) -> Column:
    """FN-37."""
    return F.abs(micros(a) - micros(b)) / 3.6e9


def temporal_weight(hours: Column) -> Column:
    """FN-38."""
    return 1 / (1 + hours)


def retryable(message: Column) -> Column:
    """FN-34: errors of connections, of rate limits and of the server."""
    low = F.lower(message)
    return _any(low, ("timeout", "connection", "network", "socket", "rate limit", "429", "500", "502", "503", "504"))
