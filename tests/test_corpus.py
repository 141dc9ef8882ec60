import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from tallyroll.operators import corpus as K
from tallyroll.operators import scoring as S
from tallyroll.operators.ordinals import dense_ordinal
from tallyroll.operators.requests import build_requests
from tallyroll.sources import annotations, images, reports, shards


def test_dense_ordinal_with_equal_rows(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k")).repartition(6)
    got = dense_ordinal(df, "k").collect()
    assert sorted(r.ordinal for r in got) == list(range(3000))
    assert all(r.k == r.ordinal // 1000 for r in got)


@pytest.mark.parametrize("n, want", [(1, 1), (3, 1), (1000, 100), (29, 2)])
def test_split_is_exact(spark, n, want):
    df = spark.range(n).withColumnRenamed("id", "key")
    split = K.split_train_val(df, "key", 0.1, 42)
    assert K.only_split(split, "val").count() == want
    assert K.only_split(split, "train").count() == n - want
    again = K.split_train_val(df.repartition(5), "key", 0.1, 42)
    assert split.exceptAll(again.select(*split.columns)).isEmpty()


def test_split_of_nothing(spark):
    assert K.split_train_val(spark.range(0).withColumnRenamed("id", "key"), "key").count() == 0


def test_batches_and_shuffle(spark):
    df = spark.range(10).withColumnRenamed("id", "key")
    plain = K.batches(df, "key", 4, seed=None).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in plain] == [4, 4, 2]
    first = [r.key for r in K.shuffled(df, "key", 1, 0).collect()]
    assert sorted(first) == list(range(10))
    assert first == [r.key for r in K.shuffled(df, "key", 1, 0).collect()]
    assert first != [r.key for r in K.shuffled(df, "key", 1, 1).collect()]
    assert K.first_n(df, "key", None).count() == 10 and K.first_n(df, "key", 3).count() == 3


def test_json_lines_keep_file_order(spark, tmp_path):
    # two files, the first one smaller, so size order and name order differ
    (tmp_path / "a.jsonl").write_text('{"n":0}\n\n  \n{"n":1}\n')
    (tmp_path / "b.jsonl").write_text("".join(f'{{"n":{n}}}\n' for n in range(2, 400)))
    got = annotations.read_annotations(spark, str(tmp_path)).collect()
    assert sorted(r.ordinal for r in got) == list(range(400))
    assert all(json.loads(r.json)["n"] == r.ordinal for r in got)


def test_malformed_line_fails(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"n":0}\n{bad\n')
    with pytest.raises(Exception, match="malformed JSON line"):
        annotations.read_annotations(spark, str(tmp_path)).collect()


def test_malformed_line_fails_without_its_column(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"n":0}\n{bad\n')
    with pytest.raises(Exception, match="malformed JSON line"):
        annotations.read_annotations(spark, str(tmp_path)).count()


def test_lines_survive_other_splits(spark, tmp_path):
    """Splits may differ between the time a frame is built and the time it runs."""
    (tmp_path / "a.jsonl").write_text("".join(f'{{"n":{n},"pad":"{"x" * 50}"}}\n' for n in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        lines = annotations.json_lines(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        got = lines.select("ordinal", F.get_json_object("json", "$.n").cast("int").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 20_000 and all(r.ordinal == r.n for r in got)


def test_incomplete_samples_fail(spark, tmp_path):
    import io
    import tarfile

    def packed(name, members):
        (tmp_path / name).mkdir()
        with tarfile.open(tmp_path / name / "000000.tar", "w") as tar:
            for member in members:
                info = tarfile.TarInfo(member)
                info.size = 2
                tar.addfile(info, io.BytesIO(b"{}"))
        return shards.read_shards(spark, str(tmp_path / name))

    assert packed("whole", ["0.jpg", "0.json", "1.json", "1.jpg", "1.txt"]).count() == 2
    for i, members in enumerate((["0.jpg"], ["0.json", "1.jpg", "1.json"], ["0.png", "0.json"], ["0.jpg", "0.json", "1.txt"])):
        with pytest.raises(Exception, match="incomplete sample"):
            packed(f"broken{i}", members).collect()


def test_listing_below_a_repeated_name(spark, tmp_path):
    deep = tmp_path / "img" / "sub" / "img"
    deep.mkdir(parents=True)
    (deep / "f.jpg").write_bytes(b"x")
    assert [r.key for r in images.list_prefix(spark, str(tmp_path / "img")).collect()] == ["sub/img/f.jpg"]
    assert [r.name for r in images.list_folder(spark, str(tmp_path / "img")).collect()] == ["sub"]
    assert images.list_prefix(spark, str(tmp_path / "img"), "x").count() == 0


def test_eval_jobs_and_sink(spark, tmp_path):
    df = spark.createDataFrame([("x.jpg", '{"total": 1,\r\n"store": null}')], "image_path string, annotation string")
    annotations.write_json_lines(df.withColumn("gone", F.lit(None).cast("string")), f"{tmp_path}/out")
    text = spark.read.text(f"{tmp_path}/out").first()[0]
    assert json.loads(text)["gone"] is None
    annotations.write_json_lines(df, f"{tmp_path}/raw", "annotation")
    raw = spark.read.text(f"{tmp_path}/raw").collect()
    assert len(raw) == 1 and json.loads(raw[0][0]) == {"total": 1, "store": None}
    (tmp_path / "jobs.jsonl").write_text('{"image_path": "i.jpg", "annotation": {"total": 2}}\n')
    job = annotations.read_eval_jobs(spark, f"{tmp_path}/jobs.jsonl").first()
    assert job.image_path == "i.jpg" and json.loads(job.annotation) == {"total": 2}


def test_raw_corpora(spark, tmp_path):
    spark.createDataFrame(
        [(b"i", None, "{}"), (None, "{}", None)], "image binary, ground_truth string, gt_parse_str string"
    ).write.parquet(f"{tmp_path}/c")
    got = annotations.read_cord(spark, f"{tmp_path}/c").collect()
    assert len(got) == 1 and got[0].ground_truth == "{}"
    spark.sql("select binary('i') image, named_struct('total', '5') parsed_data").write.parquet(f"{tmp_path}/s")
    assert json.loads(annotations.read_sroie(spark, f"{tmp_path}/s").first().parsed_data) == {"total": "5"}


def test_images(spark, tmp_path):
    os.makedirs(tmp_path / "img/sub")
    (tmp_path / "img/a.jpg").write_bytes(b"hello")
    (tmp_path / "img/sub/b.jpg").write_bytes(b"x")
    base = str(tmp_path / "img")
    assert [r.name for r in images.list_folder(spark, base).collect()] == ["a.jpg", "sub"]
    assert [r.key for r in images.list_prefix(spark, base, "su").collect()] == ["sub/b.jpg"]
    plan = images.list_folder(spark, base)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    read = images.read_images(spark, base)
    assert {r.name: bytes(r.content) for r in read.collect()} == {"a.jpg": b"hello", "b.jpg": b"x"}
    want = spark.createDataFrame([("a.jpg",), ("c.jpg",)], "name string")
    assert [r.name for r in images.existing(want, read, "name").collect()] == ["a.jpg"]
    assert [r.name for r in images.missing(want, read, "name").collect()] == ["c.jpg"]
    records = spark.createDataFrame([(0, "p/a.jpg"), (1, None)], "ordinal int, image_path string")
    found = {r.image_name: r.exists for r in K.resolve_images(records, read).collect()}
    assert found == {"a.jpg": True, "cord_00001.jpg": False}


def test_shards(spark, tmp_path):
    df = spark.range(25).select(
        F.col("id").alias("key"),
        F.encode(F.col("id").cast("string"), "UTF-8").alias("jpg"),
        F.to_json(F.struct("id")).alias("json"),
    )
    out = f"{tmp_path}/shards"
    shards.write_shards(K.assign_shards(df, "key", 10), out)
    assert sorted(os.listdir(out)) == ["000000.tar", "000001.tar", "000002.tar"]
    with tarfile.open(f"{out}/000002.tar") as tar:
        assert tar.getnames() == [f"{i:06d}.{k}" for i in range(5) for k in ("jpg", "json")]
    read = shards.read_shards(spark, out)
    assert read.rdd.getNumPartitions() == 3
    got = read.orderBy("shard_id", "idx").collect()
    assert [int(bytes(r.jpg)) for r in got] == list(range(25))
    assert shards.read_shards(spark, out + "/{000000..000001}.tar").count() == 20
    for i in range(3):
        (tmp_path / f"{i}.jpg").write_bytes(str(i).encode())
    by_uri = spark.range(3).select(
        F.lit(0).cast("bigint").alias("shard_id"),
        F.col("id").alias("idx"),
        F.concat(F.lit(f"{tmp_path}/"), F.col("id").cast("string"), F.lit(".jpg")).alias("uri"),
        F.lit("{}").alias("json"),
    )
    shards.write_shards(by_uri, f"{tmp_path}/by_uri")
    assert [bytes(r.jpg) for r in shards.read_shards(spark, f"{tmp_path}/by_uri").orderBy("idx").collect()] == [b"0", b"1", b"2"]
    assert shards.expand_braces("a/{08..10}.tar") == ["a/08.tar", "a/09.tar", "a/10.tar"]


def _numbered(spark, path, n=60, size=20):
    df = spark.range(n).select(
        F.col("id").alias("key"), F.encode(F.col("id").cast("string"), "UTF-8").alias("jpg"),
        F.to_json(F.struct("id")).alias("json"))
    shards.write_shards(K.assign_shards(df, "key", size), path)


def test_only_what_is_asked_for_is_read(spark, tmp_path):
    out = f"{tmp_path}/shards"
    _numbered(spark, out)
    for other in ("000000.tar", "000002.tar"):  # reading either of them fails
        with open(f"{out}/{other}", "wb") as broken:
            broken.write(b"no tar" * 1000)
    asked = shards.read_shards(spark, out, only=[1])
    assert asked.rdd.getNumPartitions() == 1 and asked.count() == 20
    # a query's filter changes nothing for the next one over the same rows
    assert asked.filter("idx < 3").count() == 3 and asked.count() == 20
    assert asked.filter("idx < 3").union(asked.filter("idx > 17")).count() == 5
    assert shards.read_shards(spark, out, only=[]).count() == 0
    with pytest.raises(Exception):
        shards.read_shards(spark, out).count()
    whole = shards.read_shards(spark, out + "/000001.tar", ["idx", "json"])
    assert whole.columns == ["idx", "json"] and sorted(r.idx for r in whole.collect()) == list(range(20))
    wanted = shards._Reader({"path": out}, ["json"])
    taken = []
    read_member = tarfile.TarFile.extractfile
    try:
        tarfile.TarFile.extractfile = lambda tar, member: taken.append(member.name) or read_member(tar, member)
        assert len(list(wanted.read(shards._Shard(f"{out}/000001.tar", 1)))) == 20
    finally:
        tarfile.TarFile.extractfile = read_member
    assert len(taken) == 20 and all(name.endswith(".json") for name in taken)


def test_buffered_epochs(spark, tmp_path):
    out = f"{tmp_path}/shards"
    _numbered(spark, out)

    def epoch(seed, buffer=8):
        rows = shards.read_shards(spark, out, seed=seed, buffer=buffer).orderBy("shard_place", "place").collect()
        assert [(r.shard_place, r.place) for r in rows] == [(s, i) for s in range(3) for i in range(20)]
        return [(r.shard_id, r.idx) for r in rows]

    first = epoch("3:0")
    assert sorted(first) == [(s, i) for s in range(3) for i in range(20)] and first != sorted(first)
    assert epoch("3:0") == first and epoch("3:1") != first
    assert len({tuple(s for s, _ in epoch(f"3:{e}")[::20]) for e in range(12)}) > 1  # shards change places, too
    assert all(idx <= place % 20 + 8 for place, (_, idx) in enumerate(first))  # no sample leaves before it came
    assert [i for _, i in epoch("3:0", 1)] == list(range(20)) * 3
    part = shards.read_shards(spark, out, only=[2], seed="3:0", buffer=8).filter("idx < 5").collect()
    at = {key: place for place, key in enumerate(first)}
    assert len(part) == 5 and all(at[r.shard_id, r.idx] == r.shard_place * 20 + r.place for r in part)
    with pytest.raises(ValueError, match="buffer"):
        shards.read_shards(spark, out, seed="1", buffer=0)


def test_many_shards_share_a_task(spark, tmp_path):
    out = f"{tmp_path}/shards"
    _numbered(spark, out)
    reader = shards._Reader({"path": out, "tasks": "2"}, ["shard_id", "idx"])
    parts = reader.partitions()
    assert [[s.number for s in p.shards] for p in parts] == [[0, 1], [2]]
    assert [row for p in parts for row in reader.read(p)] == [(s, i) for s in range(3) for i in range(20)]


def test_texts_as_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"k={i % 400}.txt", f"text {i % 400}") for i in range(800)], "name string, value string")
    images.write_texts(rows, f"{tmp_path}/in")
    found = images.read_images(spark, f"{tmp_path}/in").select("name", F.decode("content", "UTF-8").alias("text")).collect()
    assert sorted((r.name, r.text) for r in found) == sorted((f"k={i}.txt", f"text {i}\n" * 2) for i in range(400))
    assert len(os.listdir(tmp_path / "in")) <= images._FOLDERS  # folders do not grow with the files


def test_shuffle_buffer_against_brute_force():
    draws = [2, 0, 1, 1, 0, 0]
    queue = iter(draws)
    # a b c held; d pushes c out, e pushes a, f pushes b; then e f d leave as drawn
    assert list(shards.buffered("abcdef", 3, lambda n: next(queue))) == ["c", "a", "b", "f", "e", "d"]
    assert list(shards.buffered("", 3, lambda n: 0)) == []


def test_failed_task_leaves_no_shard(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, "{}", "/none/there.jpg")], "shard_id long, idx long, json string, uri string")
    with pytest.raises(Exception, match="there.jpg"):
        shards.write_shards(rows, f"{tmp_path}/failed")
    assert os.listdir(tmp_path / "failed") == []


def test_training_targets_and_requests(spark):
    df = spark.createDataFrame([("{}",), ('{"a": 1, "b": 2}',)], "json string")
    got = K.training_targets(df, max_length=2).collect()
    assert got[0].tokens == ["<s_receipt>{}</s_receipt>"] and not got[0].truncated
    assert got[1].n_tokens == 2 and got[1].truncated
    asked = build_requests(
        spark.createDataFrame([(bytearray(b"abc"), None), (bytearray(b"abc"), "bad")], "content binary, failed string"),
        "{}",
        failed="failed",
    ).collect()
    assert [len(r.messages) for r in asked] == [1, 3]
    image, prompt = asked[0].messages[0].content
    assert image.data == "YWJj" and prompt.text.endswith("Schema: {}")
    assert [m.role for m in asked[1].messages] == ["user", "assistant", "user"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"total":1}')], "receipt_id int, j string").select(
        "receipt_id", S.scorable_json(F.col("j")).alias("pred"), S.scorable_json(F.col("j")).alias("gt")
    )
    scored = S.score_receipts(df)
    reports.write_report(scored, ["*"], f"{tmp_path}/r")
    lines = spark.read.text(f"{tmp_path}/r/summary").collect()
    summary = json.loads(lines[0][0])
    assert len(lines) == 1 and summary["total"]["f1"] == 1.0 and summary["overall_f1"] == 0.2
    table = spark.sql(
        "select 0 rank, 'm' model_id, 1d store_name_f1, 1d total_f1, 1d item_name_f1, 1d item_total_f1, "
        "1d item_qty_f1, 1d overall_f1, false skipped, cast(null as string) reason union all "
        "select 1, 'n', null, null, null, null, null, null, true, 'no key'"
    )
    reports.write_comparison(table, f"{tmp_path}/c")
    rows = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/c").collect()]
    assert rows[0]["m"]["overall_f1"] == 1.0 and rows[1]["n"] == {"skipped": True, "reason": "no key"}


def test_report_scores_once(spark, tmp_path):
    """The scoring input is read once for summary and samples; the summary equals the means, also without samples."""
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    texts = spark.createDataFrame([(i, f'{{"total":{i % 3 + 1}}}', '{"total":1}') for i in range(50)], "receipt_id int, p string, g string")
    df = texts.mapInArrow(seen, texts.schema).select("receipt_id", S.scorable_json(F.col("p")).alias("pred"), S.scorable_json(F.col("g")).alias("gt"))
    scored = S.score_receipts(df)
    reports.write_report(scored, ["receipt_id"], f"{tmp_path}/r")
    assert calls.value == 50
    said = json.loads(spark.read.text(f"{tmp_path}/r/summary").first()[0])
    means = reports.report_summary(S.mean_scores(scored)).first().asDict(recursive=True)
    assert said["total"] == pytest.approx(means["total"]) and said["overall_f1"] == pytest.approx(means["overall_f1"])
    assert spark.read.json(f"{tmp_path}/r/samples").count() == 50
    reports.write_report(scored.limit(0), ["receipt_id"], f"{tmp_path}/none")
    assert json.loads(spark.read.text(f"{tmp_path}/none/summary").first()[0])["overall_f1"] == 0.0


def test_report_samples_are_compressed(spark, tmp_path):
    df = spark.createDataFrame([(i, '{"total":1}') for i in range(20)], "receipt_id int, j string").select(
        "receipt_id", S.scorable_json(F.col("j")).alias("pred"), S.scorable_json(F.col("j")).alias("gt"))
    reports.write_report(S.score_receipts(df), ["receipt_id", F.struct("total").alias("scores")], f"{tmp_path}/r")
    assert not list(tmp_path.glob("r/samples/*.json")) and list(tmp_path.glob("r/samples/*.json.gz"))
    assert sorted(json.loads(r[0])["receipt_id"] for r in spark.read.text(f"{tmp_path}/r/samples").collect()) == list(range(20))
