import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import embedding, places, ranking, vector_search
from lectern.sources import corpus, frames, vector_store
from lectern.sources import places as place_source

VERSES = [
    {"libro": "Salmos", "abbr": "Sal", "capitulo": 1, "versiculo": 1, "texto": "uno"},
    {"libro": "Salmos", "abbr": "Sal", "capitulo": 1, "versiculo": 2, "texto": "dos\nlíneas"},
    {"libro": "Salmos", "abbr": "Sal", "capitulo": 1, "versiculo": 1, "texto": "otra vez"},
]


@pytest.mark.parametrize("indent", [None, 2])
def test_passage_file_keeps_file_order(spark, tmp_path, indent):
    (tmp_path / "p.json").write_text(json.dumps(VERSES, indent=indent, ensure_ascii=False), encoding="utf-8")
    rows = corpus.read_passages(spark, str(tmp_path / "p.json")).orderBy("pos").collect()
    assert [(r.pos, r.ref, r.text) for r in rows] == [(0, "Sal 1:1", "uno"), (1, "Sal 1:2", "dos\nlíneas"), (2, "Sal 1:1", "otra vez")]


def test_passages_round_trip(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(VERSES), encoding="utf-8")
    corpus.write_passages(corpus.read_passages(spark, str(tmp_path / "p.json")), str(tmp_path / "out"))
    assert (tmp_path / "out" / "abbr=Sal").is_dir()
    assert corpus.read_written_passages(spark, str(tmp_path / "out")).count() == 3


def test_whole_documents_keep_layout(spark, tmp_path):
    (tmp_path / "a.txt").write_text("uno\n\n  dos\n", encoding="utf-8")
    rows = corpus.read_documents(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].value == "uno\n\n  dos\n" and rows[0].doc_id.endswith("a.txt")


def test_missing_qa_is_empty(spark, tmp_path):
    assert corpus.read_qa(spark, str(tmp_path / "no.json")).count() == 0
    (tmp_path / "qa.json").write_text('[{"id": 0, "numero": 4, "pregunta": "p", "respuesta": "r"}, {"id": 7, "numero": 9, "pregunta": "q", "respuesta": "s"}]')
    assert [r.id for r in corpus.read_qa(spark, str(tmp_path / "qa.json")).orderBy("pos").collect()] == [0, 7]


def test_float_and_packed_files(spark, tmp_path):
    v = np.array([[0.5, -0.25, 1, 0], [-1, 0.1, 0, 0.2], [0, 0, 0, 0]], dtype="float32")
    (tmp_path / "f.json").write_text(json.dumps({"model": "m", "dim": 4, "verses": [{"ref": f"r{i}", "v": x.tolist()} for i, x in enumerate(v)]}))
    floats = vector_store.read_float_vectors(spark, str(tmp_path / "f.json"))
    quantized = vector_search.quantize_store(floats).orderBy("pos").collect()
    packed = np.array([r.q for r in quantized], dtype=np.int8)
    assert packed[1].tolist() == [-127, 13, 0, 25]
    (tmp_path / "q.bin").write_bytes(packed.tobytes())
    (tmp_path / "q.json").write_text(json.dumps({"model": "m", "dim": 4, "count": 3, "refs": ["r0", "r1", "r2"], "scales": [r.scale for r in quantized]}))
    rows = vector_store.read_packed_vectors(spark, str(tmp_path / "q.bin"), str(tmp_path / "q.json")).orderBy("pos").collect()
    assert [(r.ref, r.q, r.model, r.dim) for r in rows] == [(r.ref, r.q, "m", 4) for r in quantized]
    assert [r.scale for r in rows] == [1.0, 1.0, 0.0]


def test_vector_store_round_trip(spark, tmp_path):
    store = spark.createDataFrame([("a", [1.0, -0.5], "m", 2)], "ref string, v array<float>, model string, dim int")
    vector_store.write_vector_store(vector_search.quantize_store(store), str(tmp_path / "s"))
    assert vector_store.read_vector_store(spark, str(tmp_path / "s")).first().q == [127, -63]
    assert tuple(spark.read.parquet(str(tmp_path / "s" / "meta")).first()) == ("m", 2, 1)


def test_torn_frame_is_withheld(spark):
    text = 'event: verse\ndata: {"a": 1}\n\n: note\n\nevent: a\nevent: b\ndata: 1\ndata: 2\n\nevent: c\ndata: {bad}\n\ndata: [1] x\n\ndata: 7'
    rows = frames.parse_frames(spark.createDataFrame([("s", text)], "stream_id string, text string")).collect()
    assert [(r.seq, r.event, r.data) for r in rows] == [(0, "verse", '{"a": 1}'), (2, "b", "2")]


def test_places(spark):
    body = json.dumps(
        {
            "places": [
                {"id": "a", "displayName": {"text": "Parroquia"}, "location": {"latitude": 40.0, "longitude": -3.5},
                 "internationalPhoneNumber": "+34 1", "photos": [{}, {"name": ""}] + [{"name": f"n{i}"} for i in range(12)],
                 "editorialSummary": {"text": "bonita"}},
                {"id": "b", "displayName": {"text": "Iglesia EVANGÉLICA"}, "location": {"latitude": 1.0, "longitude": 2.0}},
                {"id": "c", "displayName": {}, "location": {"latitude": 1.0, "longitude": 2.0}},
                {"id": "d", "displayName": {"text": "Sin sitio"}},
            ]
        }
    )
    raw = spark.createDataFrame([(1, body), (2, "{}")], "request int, body string")
    flat = places.flatten(place_source.parse_places(raw))
    assert flat.count() == 4
    kept = places.keep(flat).collect()
    assert [r.place_id for r in kept] == ["a"]
    a = kept[0]
    assert (a.address, a.phone, a.photo_name, a.opening_hours) == ("", "+34 1", "n0", None)
    assert a.maps_url.endswith("query=40,-3.5&query_place_id=a")
    d = places.detail(flat).filter("place_id = 'a'").first()
    assert d.distance == 0 and d.photo_names == [f"n{i}" for i in range(10)] and d.description == "bonita"
    origins = spark.createDataFrame([("a", (41.0, -3.5)), ("d", None)], "place_id string, origin struct<lat: double, lng: double>")
    far = places.detail(flat, origins).collect()
    assert len(far) == 1 and far[0].distance == pytest.approx(111194.9, abs=0.1)


@pytest.mark.parametrize("block_bytes", [64 << 20, 1_000])
def test_nearest_places(spark, block_bytes):
    points = [(i, (i * 37 % 120) - 60.0, (i * 91 % 360) - 180.0) for i in range(150)] + [(200, 0.0, 0.0), (201, 0.0, 0.0)]
    shops = spark.createDataFrame(points, "pos bigint, lat double, lng double").repartition(3)
    centres = spark.createDataFrame([(i, i - 10.0, i * 8.0 - 90) for i in range(20)] + [(77, 0.0, 0.0)], "centre_id int, lat double, lng double")
    got = places.nearest(centres, shops, 5, block_bytes).collect()
    from lectern.functions.geo import haversine

    c = centres.select("centre_id", F.col("lat").alias("a"), F.col("lng").alias("b"))
    metres = c.crossJoin(shops).select("centre_id", "pos", F.round(haversine(F.col("a"), F.col("b"), F.col("lat"), F.col("lng")), 6).alias("m")).collect()
    want = []
    for centre in {r.centre_id for r in metres}:
        best = sorted((r.m, r.pos) for r in metres if r.centre_id == centre)[:5]
        want += [(centre, pos, i + 1) for i, (_, pos) in enumerate(best)]
    assert sorted((r.centre_id, r.pos, r["rank"]) for r in got) == sorted(want)
    assert [r.pos for r in sorted((r for r in got if r.centre_id == 77), key=lambda r: r["rank"])][:2] == [200, 201]


def test_centre_choice(spark):
    asked = spark.createDataFrame(
        [(1, 1.0, 2.0, "Madrid", 10.0), (2, None, 2.0, " Madrid ", None), (3, None, None, "Nada", 1e9), (4, None, None, " ", 1.0)],
        "centre_id int, lat double, lng double, address string, radius double",
    )
    known = spark.createDataFrame([("Madrid", 40.4, -3.7, "Madrid, España")], "address string, lat double, lng double, formatted_address string")
    good, bad = places.choose_centres(asked, known)
    assert sorted(tuple(r) for r in good.collect()) == [(1, 1.0, 2.0, None, 500.0), (2, 40.4, -3.7, "Madrid, España", 5000.0)]
    assert sorted(tuple(r) for r in bad.collect()) == [(3, "address not found"), (4, "no position and no address")]


class Flaky:
    """Fails now and then, and notes nothing: providers run in the tasks."""

    model = "flaky"

    def __init__(self):
        self.calls = 0

    def embed(self, texts):
        self.calls += 1
        if self.calls % 3 == 1:
            raise embedding.RateLimited
        if self.calls % 3 == 2:
            raise OSError("broken pipe")
        assert len(texts) <= 10
        return [[float(len(t)), 1.0] for t in texts]


def _patient(call):
    return embedding.call_with_retries(call, sleep=lambda s: None)


def test_embedding_batches_with_retries(spark):
    rows = spark.range(95).select(F.col("id").cast("string").alias("ref"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    got = embedding.embed(rows.repartition(2), Flaky(), batch=10, retry=_patient).collect()
    assert sorted((int(r.ref), r.v[0], r.dim, r.model) for r in got) == [(i, float(i), 2, "flaky") for i in range(95)]
    assert max(r.batch_rows for r in got) == 10


def test_retry_waits():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise embedding.RateLimited
        raise OSError

    with pytest.raises(OSError):
        embedding.call_with_retries(call, sleep=waits.append)
    assert waits == [30.0, 30.0, 30.0, 2.0, 4.0, 8.0, 16.0]


def test_resume_is_by_key_and_model(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "ref string, text string")
    stored = spark.createDataFrame([("a", "m"), ("b", "old")], "ref string, model string")
    assert sorted(r.ref for r in vector_search.unembedded(rows, stored, "m").collect()) == ["b", "c"]


def test_row_numbers_across_ranges(spark):
    rows = [("hot", i * 3 - 500) for i in range(1000)] + [("cold", 5), ("cold", -7)]
    frame = spark.createDataFrame(rows, "key string, at int").repartition(7)
    got = ranking.row_numbers(frame, "key", "at", "n", width=64).collect()
    assert all(r.n == (r["at"] + 500) // 3 + 1 for r in got if r.key == "hot") and len(got) == 1002
    assert {(r["at"], r.n) for r in got if r.key == "cold"} == {(-7, 1), (5, 2)}
