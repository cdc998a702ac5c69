"""Edge cases of operators, readers, writers, providers, streams and the pipeline."""

from __future__ import annotations

import difflib
import hashlib
import hmac
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from evidencegraph.functions import scalars as S
from evidencegraph.functions.similarity import block_ratio, composite
from evidencegraph.operators import context, datagen, graph, intake, metrics, providers, pseudonymize, quality, resolve
from evidencegraph.plans import pipeline
from evidencegraph.sources import readers, writers
from evidencegraph.streaming import fusion


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [("", ""), (None, ""), ("0", "1970-01-01 00:00:00"), ("1700000000", "2023-11-14 22:13:20"), ("1700000000000", "2023-11-14 22:13:20"), ("10000000000", "2286-11-20 17:46:40"), ("2023-10-01T08:09:10", "2023-10-01 08:09:10"), ("2023-10-01", "2023-10-01 00:00:00"), ("soon", "soon"), ("9" * 30, "9" * 30)],
)
def test_times(spark, raw, want):
    assert one(spark, S.normalized_time(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("text", "want"), [('a {"voiceLength": "7"} b', 7), ("voiceLength: 12", 12), ("{voiceLength: 12", 12), ("{voiceLength: 12}", 0), ("", 0), ('{"voiceLength": "x"}', 0)])
def test_durations(spark, text, want):
    assert one(spark, S.voice_duration(F.col("t")), t=text) == want


@pytest.mark.parametrize(("ref", "hyp", "cer", "wer"), [("", "", 0, 0), ("", "a", 1, 1), ("abc", "", 1, 1), ("a b c", "a x c d", 0.6, 2 / 3), ("日本", "日木", 0.5, 1), ("a", "b c d", 5, 3)])
def test_error_rates(spark, ref, hyp, cer, wer):
    assert one(spark, S.error_rate(F.col("r"), F.col("h")), r=ref, h=hyp) == pytest.approx(cer)
    assert one(spark, S.word_error_rate(F.col("r"), F.col("h")), r=ref, h=hyp) == pytest.approx(wer)


def test_error_rates_of_one_row(spark):
    r = metrics.error_rates(spark.createDataFrame([("a b", "a c")], "reference string, hypothesis string")).first()
    assert (r.samples, r.avg_wer, r.std_wer, r.std_cer) == (1, 0.5, 0.0, 0.0)


def test_macro_f1_in_any_order(spark):
    for order in itertools.permutations((0.0, 0.5471, 0.6283, 0.7296)):  # their mean, 0.47625, is a tie
        scores = spark.createDataFrame([(x,) for x in order], "f1 double").coalesce(1)
        assert (metrics.macro_f1(scores).first()[0], metrics.macro_f1(scores, 6).first()[0]) == (0.4763, 0.47625)
    assert metrics.macro_f1(scores.limit(0)).first()[0] is None


def test_keys(spark):
    assert one(spark, S.normalized_phone(F.col("p")), p="+86 138-0013-8000") == "13800138000"
    assert one(spark, S.normalized_name(F.col("p")), p="　Ann B\t") == "ann b"
    assert one(spark, S.normalized_idcard(F.col("p")), p=" 1101 x") == "1101X"


@pytest.mark.parametrize("salt", ["s", "a long salt " * 8, ""])
def test_tags(spark, salt):
    want = "name_" + hmac.new(salt.encode(), "王é".encode(), hashlib.sha256).hexdigest()[:10]
    assert one(spark, S.keyed_tag(F.lit("name"), F.col("r"), salt), r="王é") == want


def test_person_tokens_and_drugs(spark):
    assert one(spark, S.person_tokens(F.col("t")), t="王小明 Ann x Red A 王小明王 Ann") == ["王小明", "Ann", "王小明王", "Ann"]
    got = one(spark, S.drug_mentions(F.col("t")), t="Aspirin 20 mg, PANADOL 3 boxes")
    assert [(x.name, x.quantity) for x in got] == [("Aspirin", "20 mg"), ("Panadol", "20 mg")]


def test_ratio_is_of_ordered_arguments(spark):
    rows = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", "")], "a string, b string")
    got = [r.x for r in rows.select(block_ratio("a", "b").alias("x")).collect()]
    assert got == [difflib.SequenceMatcher(None, *p).ratio() for p in (("tide", "diet"), ("diet", "tide"), ("", ""))]
    assert rows.select(composite(F.col("a"), F.col("b")).alias("x")).first().x < 0.85


@pytest.mark.parametrize(("text", "kinds"), [("电话13800138000", []), ("电话 13800138000", ["phone"]), ("订单 1234567890123", []), ("http://a.b/c?d=e@f.com", ["url"]), ("王小明片", ["chinese_name"]), ("ann@x.org", ["email"]), ("", []), (None, [])])
def test_spans(spark, text, kinds):
    row = pseudonymize.pseudonymized(spark.createDataFrame([(1, text)], "seq long, content string"), "salt").first()
    assert [s.kind for s in row.spans] == kinds


def test_pseudonyms_go_back(spark):
    texts = ["王小明 13800138000 and 13800138000", "见 ann@example.org, 110101199003074578", ""]
    out = pseudonymize.pseudonymized(spark.createDataFrame(list(enumerate(texts)), "seq long, content string"), "salt")
    pairs = pseudonymize.mapping(out, "salt", "seq")
    assert out.filter(F.col("content").contains("13800138000")).isEmpty()
    back = pseudonymize.restored(out.select("seq", "content"), pairs, "seq").orderBy("seq")
    assert [r.content for r in back.collect()] == texts
    s = pseudonymize.statistics(out, pairs).first()
    assert s.total_processed == 2 and s.entities_found["phone"] == 1


def test_numbers_have_no_gap(spark):
    rows = spark.range(1000).select(F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, "image").when(F.col("id") % 3 == 1, "voice").otherwise("text").alias("modality"))
    got = {r.task_id: (r.modality, r.pos) for r in intake.numbered(rows).collect()}
    order = sorted(((("text", "voice", "image").index("image" if i % 3 == 0 else "voice" if i % 3 == 1 else "text"), i) for i in range(1000)))
    assert [got[f"task_{k}"][1] for k in range(1000)] == [i for _, i in order]


def test_registry_in_order(spark):
    rows = [
        (1, "Ann Bell", "13800138000", None, "text", 0.9),
        (2, "ann bell", None, "a1", "voice", 0.5),
        (3, "Zed", "+86 13800138000", None, "image", 0.4),
        (4, "Yan Wu", None, "a1", "text", 0.9),  # an account that a merge brought is no key
        (5, "Yan Wu", None, None, None, None),
        (6, None, None, None, "text", 1.0),
    ]
    entities, log = resolve.resolve_in_order(spark.createDataFrame(rows, "seq long, name string, phone string, account string, source string, confidence double"))
    got = {r.seq: (r.entity_id, r.match_level, r.matching_field) for r in log.collect()}
    assert got == {1: ("ENTITY_000001", 0, None), 2: ("ENTITY_000001", 2, "name"), 3: ("ENTITY_000001", 1, "phone"), 4: ("ENTITY_000002", 0, None), 5: ("ENTITY_000002", 2, "name"), 6: ("ENTITY_000003", 0, None)}
    first = {r.entity_id: r for r in entities.collect()}["ENTITY_000001"]
    assert first.merged_count == 3 and first.sources == ["image", "text", "voice"] and first.account == "a1" and first.name == "ann bell"


def test_blocks_don_t_change_the_registry(spark):
    r = random.Random(1)
    names = ["maria lopez", "maria lopes", "john smith", "jon smith", "li wei", "li weI", "peter", "petra", "zzz"]
    rows = [(i, r.choice(names), str(13800138000 + r.randint(0, 6)) if r.random() < 0.3 else None, f"acct{r.randint(0, 5)}" if r.random() < 0.3 else None, "s", r.random()) for i in range(80)]
    alone = resolve.Registry()
    for seq, name, phone, account, source, conf in rows:
        alone.add({"seq": seq, "name": name.lower(), "phone": phone, "account": account, "wechat": None, "idcard": None, "source": source, "confidence": conf})
    want = {seq: (at, level, field) for seq, at, level, _, field in alone.log}
    _, log = resolve.resolve_in_order(spark.createDataFrame(rows, "seq long, name string, phone string, account string, source string, confidence double"))
    assert {x.seq: (int(x.entity_id[-6:]) - 1, x.match_level, x.matching_field) for x in log.collect()} == want


def test_name_pairs_lose_no_similar_name(spark):
    r = random.Random(2)
    names = sorted({"".join(r.choice("abcde ") for _ in range(r.randint(1, 9))).strip() or "q" for _ in range(150)})
    df = spark.createDataFrame([(n,) for n in names], "n_name string")
    got = {(x.a, x.b) for x in resolve.name_pairs(df, df).collect()}
    assert {(a, b) for a in names for b in names if a != b and difflib.SequenceMatcher(None, a, b).ratio() >= resolve.LEAST_RATIO} <= got


def test_graph_of_nothing(spark):
    none = spark.createDataFrame([], "source long, target long, weight double")
    r = graph.statistics(spark.createDataFrame([], "node long"), none).first()
    assert (r.node_count, r.edge_count, r.avg_degree, r.density) == (0, 0, 0.0, 0.0)
    assert graph.components(none.select(F.col("source").alias("a"), F.col("target").alias("b"))).isEmpty()
    assert graph.shortest_path(none, 1, 2).isEmpty()


def test_paths(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 4, 1.0), (1, 3, 1.0), (3, 4, 1.0), (4, 5, 1.0), (7, 8, 1.0)], "source long, target long, weight double")
    one_ = F.lit(1).cast("long")
    assert [(r.hops, r.path) for r in graph.shortest_path(e, one_, 5).collect()] == [(3, [1, 2, 4, 5])]
    assert graph.shortest_path(e, one_, 7).isEmpty() and graph.shortest_path(e, one_, 1).first().path == [1]
    assert graph.ego_network(e, one_, 1).count() == 2


def test_components_of_a_long_chain(spark):
    e = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.components(e).agg(F.max("component"), F.count("*")).first()[:] == (0, 301)


def test_communities_beat_single_nodes(spark):
    r = random.Random(3)
    edges = [(a + 10 * g, b + 10 * g, 1.0) for g in range(4) for a in range(10) for b in range(a) if r.random() < 0.7] + [(0, 10, 1.0), (10, 20, 1.0), (20, 30, 1.0)]
    found = graph.louvain(edges)
    assert graph.modularity(found, edges) > max(0.5, graph.modularity({n: n for n in found}, edges))
    df = spark.createDataFrame(edges, "source long, target long, weight double")
    assert {x.node: x.community for x in graph.communities(df).collect()} == found


def test_votes_and_ties(spark):
    v = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (2, "x", 0)], "item long, label string, n int")
    assert {r.item: (r.label, r.confidence) for r in metrics.majority(v, "item", "label", "n").collect()} == {1: ("b", 0.5), 2: ("x", 1.0)}


def test_scores_without_rows(spark):
    r = metrics.confusion(spark.createDataFrame([], "t boolean, p boolean"), "t", "p").first()
    assert (r.tp, r.precision, r.recall, r.f1) == (0, 0.0, 0.0, 0.0)


def test_health_defaults(spark):
    r = quality.health(spark.createDataFrame([("a", 1, False, 0.9)], "g string, n long, success boolean, quality double"), "g", "n").first()
    assert (r.success_rate, r.avg_quality, r.health) == (0.0, 0.5, 0.2)


def test_nearest_against_all(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(x.query_id, x["rank"]): x.vec_id for x in context.nearest(df.filter("vec_id % 30 = 0"), df, 3).collect()}
    import numpy as np

    m = np.array([x for _, x in rows], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 30, 60):
        s = m @ m[q]
        s[q] = -2
        assert [got[q, k + 1] for k in range(3)] == np.argsort(-s, kind="stable")[:3].tolist()


def test_retries():
    calls, waits = [], []

    def failing(n):
        calls.append(n)
        raise RuntimeError("503 busy")

    with pytest.raises(RuntimeError):
        providers.Retry()(failing, waits.append)
    assert calls == [0, 1, 2, 3] and waits == [2.0, 4.0, 8.0]
    with pytest.raises(ValueError):
        providers.Retry()(lambda n: (_ for _ in ()).throw(ValueError("no")), waits.append)
    assert len(waits) == 3 and providers.differing({"a": 1}, {"a": 2, "b": 3}) == {"a": (1, 2), "b": (None, 3)}
    assert providers.Params().after(1).temperature == pytest.approx(0.35)


def test_errors_stay_with_their_rows(spark):
    class Picky(providers.Offline):
        def complete(self, prompt, params):
            if "bad" in prompt:
                raise ValueError("refused")
            return super().complete(prompt, params)

    rows = spark.createDataFrame([(1, "Aspirin"), (2, "bad"), (3, None)], "seq long, text string")
    got = {r.seq: r for r in providers.text_results(rows, "seq", "text", Picky).collect()}
    assert got[1].drugs == ["aspirin"] and got[1].confidence == 1.0 and got[2].error == "refused" and not got[2].validated and got[3].drugs == []


def test_chat_json(spark, tmp_path):
    rows = [
        {"uuid": "a", "content": "hi", "timestamp": 1}, {"uuid": "b", "timestamp": 1}, {"uuid": "c", "content": " ", "timestamp": 1}, {"uuid": "d", "content": 5, "timestamp": 1}, {"content": "x", "timestamp": 1},
        {"uuid": None, "id": "e", "content": "x", "timestamp": 1}, {"id": "f", "content": "x", "timestamp": "t"}, {"uuid": "g", "content": "x"}, {"uuid": "h", "content": "x", "timestamp": None}, {"uuid": "i", "content": "x", "timestamp": [1]},
        {"uuid": "j", "content": "x", "timestamp": True}, {"uuid": "k", "content": "x", "timestamp": 1.5},
    ]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text('{"a": 1}')
    got = {r["index"]: r.reason for r in readers.chat_json(spark, str(tmp_path / "a.json")).collect()}
    time, who = "timestamp invalid type", "missing key: uuid or id"
    assert got == {0: None, 1: "missing key: content", 2: "content invalid", 3: "content invalid", 4: who, 5: "uuid invalid", 6: None, 7: time, 8: time, 9: time, 10: None, 11: None}
    assert [(r["index"], r.reason) for r in readers.chat_json(spark, str(tmp_path / "b.json")).collect()] == [(-1, "root not array")]


def test_csv_and_media(spark, tmp_path):
    media = tmp_path / "media" / "deep"
    media.mkdir(parents=True)
    for name in ("msg_v1_x.mp3", "i1.PNG", "a_v1.wav", "note.txt", "v9.doc"):
        (media / name).write_text("text of a note")
    (tmp_path / "m.csv").write_text('﻿UUID,msgType,content,talker,des,createTime\nt1,1,"hello\nthere",ann,bob,1700000000\nv1,34,"{""voiceLength"": 3}",ann,bob,1700000000000\ni1,3,,ann,bob,\nv9,34,,a,b,1\n,1,x,a,b,1\nx1,43,x,a,b,1\n', encoding="utf-8")
    got = {r.uuid: r for r in readers.message_csv(spark, str(tmp_path / "m.csv"), str(tmp_path / "media")).collect()}
    assert set(got) == {"t1", "v1", "i1"}
    assert got["t1"].content == "hello\nthere" and got["t1"].timestamp == "2023-11-14 22:13:20" and got["v1"].duration == 3
    assert got["v1"].file_path.endswith("a_v1.wav") and got["i1"].file_path.endswith("i1.PNG") and got["i1"].timestamp == ""
    folder = {r.uuid: (r.modality, r.content) for r in readers.folder(spark, str(tmp_path / "media")).collect()}
    assert folder["note"] == ("text", "text of a note") and folder["i1"] == ("image", None) and "v9" not in folder
    assert readers.collected(spark).isEmpty() and readers.collected(spark, directory=str(tmp_path / "media")).count() == 4


def test_annotation_readers(spark, tmp_path):
    put = lambda name, x: (tmp_path / name).write_text(x if isinstance(x, str) else json.dumps(x)) and str(tmp_path / name)
    assert readers.user_roles(spark, put("m.json", {"u1": "a", "u2": "b"})).count() == 2
    assert readers.user_roles(spark, put("l.json", [{"user": "u", "true_role": "a", "predicted_role": "b"}])).first().predicted_role == "b"
    assert readers.asr_samples(spark, put("s.json", [{"id": 1, "reference_text": "x", "hypothesis": "y"}])).first()[:] == (1, "x", "y")
    assert readers.image_annotations(spark, put("i.json", [{"id": 1, "type": "drug_box", "contains_drugs": True}])).first().image_type == "drug_box"
    assert readers.envelope(spark, put("e.json", {"text_entries": [{"uuid": "a"}], "image_entries": []})).first().modality == "text"
    assert readers.device_export(spark, put("d.json", ';static.report.context.data_1=[{"name": "n"}]'), "struct<name:string>").first().name == "n"


def test_generated_rows_don_t_depend_on_partitions(spark):
    a = datagen.messages(spark, 500).repartition(7).orderBy("id").collect()
    assert a == datagen.messages(spark, 500).orderBy("id").collect()
    share = datagen.relations(spark).agg(F.avg(F.col("is_related").cast("double"))).first()[0]
    assert 0.25 < share < 0.35 and datagen.relations(spark).filter("user1 = user2").isEmpty()
    assert datagen.asr_pairs(spark).agg(F.avg("cer")).first()[0] == pytest.approx(0.15, abs=0.03)


def test_streamed_registry_equals_batch(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    for k in range(3):
        rows = [("modality_output" if i % 4 else "entity_update", k * 10 + i, f" Name{i % 3} ", i / 10) for i in range(10)]
        spark.createDataFrame(rows, "type string, seq long, name string, confidence double").write.parquet(f"{source}/{k}")
    stream = spark.readStream.schema("type string, seq long, name string, confidence double").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(source))
    fusion.drained(fusion.register(stream, str(out), str(tmp_path / "check")))
    got = {r.key: (r.first_seq, r.mentions) for r in fusion.entity_table(spark.read.parquet(str(out))).collect()}
    assert got == {"name0": (3, 9), "name1": (1, 6), "name2": (2, 6)}


def test_pipeline_goes_on_from_its_tables(spark, tmp_path):
    rows = [{"uuid": f"u{i}", "content": f"Ann took Aspirin with Bob {i}", "timestamp": 1700000000 + i, "type": "text"} for i in range(5)] + [{"uuid": "x"}]
    (tmp_path / "in.json").write_text(json.dumps(rows))
    r = pipeline.run(spark, str(tmp_path / "in.json"), str(tmp_path / "run"), "salt")
    # longer words became pseudonyms before anything is extracted; tags begin with capitals, as names do
    assert {e.key for e in r.tables["entities"].collect() if not e.key.startswith("wechat_")} == {"ann", "bob"}
    assert r.tables["edges"].count() >= 1 and r.tables["timeline"].count() >= 1
    report = spark.read.json(str(tmp_path / "run/report")).first()
    assert (report.valid_count, report.error_count) == (5, 1)
    (tmp_path / "in.json").write_text("[]")  # the finished stages aren't made again
    assert pipeline.run(spark, str(tmp_path / "in.json"), str(tmp_path / "run"), "salt").tables["entities"].count() == r.tables["entities"].count()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "name_1")], "raw string, pseudonym string")
    writers.mapping(df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().original == "a"
    writers.network({"entities": df}, str(tmp_path / "n"))
    assert writers.stage(df, str(tmp_path / "s")).collect() == df.collect()
