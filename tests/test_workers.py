"""Workers, lookups, names, pseudonyms of two kinds, paths, streamed registration, settings."""

from __future__ import annotations

import difflib
import json
import random

import pytest
from compare import of_spark
from pyspark.sql import functions as F

from evidencegraph import catalog, config
from evidencegraph.functions import scalars as S
from evidencegraph.operators import graph, intake, metrics, providers, pseudonymize, resolve, workers
from evidencegraph.plans import pipeline, text_queries
from evidencegraph.sources import readers, writers
from evidencegraph.streaming import fusion

SMALL = "/root/testdata/sf0.001"


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, old = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
    return row[-1]


def composite(a: str, b: str) -> float:
    x, y = set(a), set(b)
    return 0.5 * difflib.SequenceMatcher(None, a, b).ratio() + 0.3 * (1 - levenshtein(a, b) / max(len(a), len(b))) + 0.2 * len(x & y) / len(x | y)


def test_same_names_are_all_pairs_of_the_score(spark):
    r = random.Random(2)
    names = set()
    for _ in range(100):
        base = "".join(r.choice("abcde ") for _ in range(r.randint(1, 16))).strip() or "q"
        names.add(base)
        for _ in range(2):
            c = list(base)
            for _ in range(r.randint(1, 3)):
                k = r.randint(0, len(c))
                c[k : k + r.randint(0, 1)] = r.choice(("", "a", "e"))
            names.add("".join(c).strip() or "z")
    df = spark.createDataFrame([(n,) for n in sorted(names)], "n_name string")
    got = {(x.a, x.b) for x in resolve.same_names(df, df).collect()}
    assert got == {(a, b) for a in names for b in names if a != b and composite(a, b) >= resolve.SAME_NAME}
    few = resolve.same_name_candidates(df, df).count()
    assert few < 0.1 * len(names) ** 2


def test_name_composite_query(spark):
    q = catalog.queries()["name_composite"](spark, SMALL).alias("q")
    s, c = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("supplier", "customer"))
    rows = q.join(s, "s_suppkey").join(c, "c_custkey").select("s_name", "c_name", "score").collect()
    assert rows and all(r.score == pytest.approx(composite(r.s_name.lower(), r.c_name.lower()), abs=1e-6) for r in rows)


def tagged(text: str, first: dict[str, str], salt: str) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with tags, by the plain rule: sort, keep what begins after the last end, replace."""
    import hashlib
    import hmac

    kept, end = [], -1
    for s in sorted(pseudonymize.candidates(text), key=lambda s: (s[0], s[0] - s[1])):
        if s[0] >= end:
            kept.append(s)
            end = s[1]
    for a, b, kind, raw in reversed(kept):
        kind = first.setdefault(raw, kind)
        text = f"{text[:a]}{kind.upper()}_{hmac.new(salt.encode(), raw.encode(), hashlib.sha256).hexdigest()[:10]}{text[b:]}"
    return text, kept


def test_pseudonymize_queries(spark):
    first: dict[str, str] = {}
    want = {}
    for r in text_queries._coded(spark, SMALL).orderBy("seq").collect():
        want[r.seq] = tagged(r.content, first, text_queries.SALT)
    got = catalog.queries()["pseudonymize_text"](spark, SMALL).collect()
    assert {r.seq: r.content for r in got} == {k: t for k, (t, _) in want.items()}
    assert {r.seq: r.n_spans for r in got} == {k: len(s) for k, (_, s) in want.items()}
    assert {r.raw: r.kind for r in catalog.queries()["pseudonym_mapping"](spark, SMALL).collect()} == first


def test_values_of_two_kinds_go_back(spark):
    # 15 digits are an id card where they stand alone, and part of an address elsewhere
    texts = ["see http://a.b/c and user abc_de", "abc_de http://a.b/c", "王小明 130105199001011", "130105199001011 王小明"]
    out = pseudonymize.pseudonymized(spark.createDataFrame(list(enumerate(texts)), "seq long, content string"), "salt", seq="seq")
    pairs = pseudonymize.mapping(out, "salt", "seq")
    back = pseudonymize.restored(out.select("seq", "content"), pairs, "seq").orderBy("seq")
    assert [r.content for r in back.collect()] == texts
    assert all(p.pseudonym.startswith(p.kind.upper() + "_") for p in pairs.collect())


def test_long_paths(spark):
    edges = spark.range(45).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"), F.lit(1.0).alias("weight"))
    assert graph.shortest_path(edges, F.lit(0).cast("long"), 45).first().hops == 45
    assert graph.distances(edges, F.lit(0).cast("long"), 3).count() == 4


@pytest.mark.parametrize(
    ("raw", "want"), [("2024-01-01T10:00:00Z", "2024-01-01 10:00:00"), ("2024-01-01T10:00:00+08:00", "2024-01-01 10:00:00"), ("2024-01-01T10:00:00.250-0530", "2024-01-01 10:00:00"), ("2024-01-01", "2024-01-01 00:00:00"), ("2024-01-01Z", "2024-01-01Z")]
)
def test_times_with_zones(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(S.normalized_time(F.col("t"))).first()[0] == want


def test_word_errors_of_many_words(spark):
    words = [f"w{i}" for i in range(45_000)]
    other = words[:44_990] + ["x"] * 10
    df = spark.createDataFrame([(" ".join(words[44_000:]), " ".join(other[44_000:]))], "a string, b string")
    assert df.select(S.word_error_rate(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.01)
    chars = spark.createDataFrame([(0xD800 - 0x3400 + 5,)], "n int").select(S.word_error_rate(F.lit("a b"), F.lit("a c"))).first()[0]
    assert chars == 0.5


def test_ties_go_to_the_first(spark):
    rows = spark.createDataFrame([("i", "z", 0.5, 2), ("i", "a", 0.5, 1), ("i", "b", 0.1, 0), ("j", None, 0.9, 0)], "item string, value string, weight double, n int")
    assert {r.item: (r.picked, r.answers) for r in metrics.ensemble(rows, "item", "value", "weight", "n").collect()} == {"i": ("a", 3), "j": (None, 0)}


def test_workers_keep_errors_with_their_rows(spark):
    class Bad(providers.Offline):
        def transcribe(self, path, params):
            raise ValueError("no such codec")

    rows = spark.createDataFrame([(1, "a/some_long-name_that_goes_on_and_on_for_fifty_characters_x.mp3"), (2, ""), (3, None)], "k long, path string")
    got = {r.k: r for r in workers.voice_results(rows, "k", "path").collect()}
    assert got[1].usable and got[1].error is None and not got[2].usable and got[2].error == got[3].error == "File not found"
    assert {r.error for r in workers.voice_results(rows, "k", "path", Bad).collect()} == {"no such codec"}
    assert workers.image_results(rows.filter("k = 9"), "k", "path").isEmpty()
    # rows without a phone or account under that very name don't match across modalities
    r = resolve.Registry()
    base = {"phone": None, "wechat": None, "idcard": None, "account": "a1", "source": "s", "confidence": 1.0}
    r.add({**base, "seq": 1, "name": "maria lopez garcia", "raw_account": None})
    r.add({**base, "seq": 2, "name": "maria lopes garza x", "account": None, "raw_account": None})
    assert [x[1] for x in r.log] == [0, 1]


def test_lookups_and_first_rows(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "bad") for i in range(300)], "index long, reason string")
    assert [r["index"] for r in intake.first_valid(rows).collect()] == list(range(1, 200, 2))
    results = spark.createDataFrame([("t", "text", True, 0.5, None)], "task_id string, modality string, success boolean, confidence double, error string")
    assert json.loads(intake.serialised_results(results).first().json) == {"task_id": "t", "modality": "text", "success": True, "confidence": 0.5, "error": None}


def test_annotations_and_trees(spark, tmp_path):
    put = lambda name, x: (tmp_path / name).write_text(json.dumps(x))
    put("A_user_roles.json", {"u": "a"})
    put("A_user_drug_relations.json", [{"id": 1, "user1": "u", "user2": "v", "is_related": True, "interaction_count": 3}])
    put("A_chat_messages.json", [{"id": 1, "user": "u", "text": "x", "has_drug_mention": False, "timestamp": 5}])
    got = readers.case_annotations(spark, str(tmp_path), "A")
    assert {k: df.count() for k, df in got.items()} == {"user_roles": 1, "user_drug_relations": 1, "chat_messages": 1}
    put("tree.json", [{"id": "1", "name": "root", "tableIndex": 0}, {"id": "2", "name": "leaf", "tableIndex": 1, "parentId": "1"}])
    assert {(r.id, r.parent) for r in readers.navigation_tree(spark, str(tmp_path / "tree.json")).collect()} == {("1", None), ("2", "1")}
    pairs = spark.createDataFrame([("a", "NAME_1"), ("b", "NAME_2")], "raw string, pseudonym string")
    writers.mapping(pairs, str(tmp_path / "m"), spark.createDataFrame([(7,)], "total_processed long"))
    assert spark.read.json(str(tmp_path / "m_totals")).first().asDict() == {"total_entities": 2, "total_processed": 7}


def test_settings_and_prompts(tmp_path):
    (tmp_path / "s.json").write_text('{"a": 1}')
    (tmp_path / "keys.example").write_text('{"key": "x"}')
    assert config.load(str(tmp_path / "s.json")) == {"a": 1}
    assert config.keys(str(tmp_path / "keys")) == {"key": "x"} and config.keys(str(tmp_path / "none")) == {}
    assert len(config.prompts("image")) == 3 and config.prompts("nothing") == []


def test_streamed_keys_match_as_in_one_table(spark, tmp_path):
    schema = "type string, seq long, name string, phone string, confidence double, source string"
    rows = [("modality_output", i, f"person {'abcdefgh'[i % 8] * 6}", str(13800138000 + i % 5) if i % 3 == 0 else None, 0.5 + i / 100, "text") for i in range(24)] + [("entity_update", 90, "person x", None, 1.0, "text")]
    for k in range(3):
        spark.createDataFrame(rows[k * 8 : k * 8 + 8] + rows[24:] * (k == 2), schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    fusion.drained(fusion.register_by_keys(stream, f"{tmp_path}/out", f"{tmp_path}/check"))
    got = {r.seq: (r.opened, r.match_level) for r in spark.read.parquet(f"{tmp_path}/out/mentions").collect()}
    one = spark.createDataFrame([r[1:] for r in rows[:24]], "seq long, name string, phone string, confidence double, source string")
    entities, log = resolve.resolve_in_order(one)
    opened = {r.entity_id: r.seq for r in entities.collect()}
    assert got == {r.seq: (opened[r.entity_id], r.match_level) for r in log.collect()}
    assert spark.read.parquet(f"{tmp_path}/out/updates").count() == 1


def test_run_tells_its_progress(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps([{"uuid": "u", "content": "Ann took Aspirin with Bob", "timestamp": 1700000000, "type": "text"}]))
    told = []
    r = pipeline.run(spark, str(tmp_path / "in.json"), str(tmp_path / "run"), "salt", progress=lambda *x: told.append(x))
    assert [t[0] for t in told] == list(pipeline.STAGES) and told[-1][1:] == (len(pipeline.STAGES),) * 2
    assert r.statistics()["intake"]["rows"] == 1


def test_queries_without_sql_are_few():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"fuzzy_match", "resolve_in_order", "communities", "generated_annotations", "name_composite", "pseudonymize_text", "pseudonym_mapping"}


def test_empty_rows(spark):
    none = of_spark(workers.dispatched(spark.createDataFrame([], "task_id long, content string, file_path string, message_type string")))
    assert none[1] == []
