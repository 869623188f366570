import pytest
from pyspark.sql import functions as F

from tracewarden.functions import arrays, text
from tracewarden.operators import encoding, ranking, sampling
from tracewarden.sources import loaders, sinks


def frame(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"row_id long, v {kind}")


def test_event_tokens_golden(spark):
    rows = frame(spark, ["[E5, E22,,E11]", "E5,E22", "[]", "[E5", " [ E1 ,\tE2 ] ", "[", "]", ",, a b ,c ,", "[[x],y]"])
    got = [r[0] for r in rows.orderBy("row_id").select(text.event_line(F.col("v"))).collect()]
    assert got == ["E5 E22 E11", "E5 E22", "", "[E5", "E1 E2", "[", "]", "a b c", "[x] y"]


def test_raw_tokens_golden(spark):
    rows = frame(spark, ["[E5,E22 E1]", "[[a b]]", "[]"])
    got = [r[0] for r in rows.orderBy("row_id").select(text.raw_line(F.col("v"))).collect()]
    assert got == ["E5,E22 E1", "a b", ""]


def traces(spark):
    rows = [(0, "[E1,E2]", "Success"), (1, "[E1]", "Anomaly"), (2, "[E3]", "weird"), (3, "[E4]", None), (4, None, "Fail"), (5, "[]", "Normal")]
    return spark.createDataFrame(rows, "row_id long, Features string, Label string")


def test_event_traces_drop_missing(spark):
    got = {tuple(r) for r in loaders.load_event_traces(spark, traces(spark)).collect()}
    assert got == {(0, "E1 E2", 0), (1, "E1", 1), (2, "E3", 1)}


def test_event_traces_keep_missing(spark):
    got = {tuple(r) for r in loaders.load_event_traces(spark, traces(spark), preprocessing={"skip_missing_labels": False}).collect()}
    assert got == {(0, "E1 E2", 0), (1, "E1", 1), (2, "E3", 1), (3, "E4", 0), (4, "missing", 1)}


def test_template_golden(spark):
    got = frame(spark, ["[*]Receiving block[*]src:[*]dest:[*]", " a [*]  b "]).orderBy("row_id").select(text.clean_template(F.col("v"))).collect()
    assert [r[0] for r in got] == ["Receiving blocksrc:dest:", "a b"]


@pytest.mark.parametrize("limit", [256, 0])
def test_enrichment_both_ways(spark, limit):
    lines = spark.createDataFrame([(0, "E1 E2 E9"), (1, "E2"), (2, ""), (3, None), (1, "E1"), (1, "E1")], "row_id long, line string")
    known = spark.createDataFrame([("E1", "open"), ("E2", "close it"), ("E2", "a")], "EventId string, EventTemplate string")
    got = [tuple(r) for r in encoding.enrich_tokens(lines, "line", known, map_limit=limit).collect()]
    want = [(0, "open close it E9"), (1, "close it"), (1, "open"), (1, "open"), (2, ""), (3, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_quantiles_both_ways(spark, limit):
    from tracewarden.operators.ranking import quantiles

    rows = spark.createDataFrame([(x,) for x in [3.0, 1.0, None, 2.0, 4.0, 4.0, None]], "v double")
    assert quantiles(rows, "v", [0, 0.25, 0.5, 0.9, 1], in_plan_limit=limit) == [1.0, 2.0, 3.0, 4.0, 4.0]
    mixed = rows.unionByName(spark.createDataFrame([(float("nan"),), (float("nan"),)], "v double"))
    got = quantiles(mixed, "v", [0, 0.5, 1], in_plan_limit=limit)
    assert got[:2] == [1.0, 4.0] and got[2] != got[2]
    assert all(x != x for x in quantiles(rows.where("v > 9"), "v", [0.5], in_plan_limit=limit))


def test_csv_types_are_found(spark, tmp_path):
    path = tmp_path / "flows.csv"
    path.write_text("id,spkts,rate,proto,gap,label\n" + "".join(f"{i},{p},{p / 4},tcp,{g},{i % 2}\n" for i, (p, g) in enumerate([(2, 1), (10, ""), (100, 3)])))
    typed = loaders.read_csv(spark, str(path), infer_types=True)
    assert dict(typed.dtypes) | {"row_id": "bigint"} == {"id": "bigint", "spkts": "bigint", "rate": "double", "proto": "string", "gap": "double", "label": "bigint", "row_id": "bigint"}
    scaled = loaders.load_unsw_nb15_cleaned(spark, str(path)).orderBy("row_id").collect()
    assert [round(r["features"][0], 4) for r in scaled] == [0.0, 0.0816, 1.0]
    whole = tmp_path / "whole.csv"
    whole.write_text("a,b,label\n0,1,0\n2,3,1\n")
    assert [r["line"] for r in loaders.load_unsw_nb15(spark, str(whole)).orderBy("row_id").collect()] == ["0 1", "2 3"]


def test_csv_with_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "broken.csv"
    path.write_text('a,b\n1,"x\ny"\n2,z\n')
    got = loaders.read_csv(spark, str(path), multi_line=True).orderBy("row_id").collect()
    assert [(r["a"], r["b"]) for r in got] == [("1", "x\ny"), ("2", "z")]
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        loaders.read_csv(spark, str(path)).collect()


def test_codes_golden(spark):
    rows = frame(spark, ["tcp", "udp", "Arp", None])
    codes = lambda word: [r["v"] for r in encoding.ordinal_encode(rows, ["v"], word).orderBy("row_id").collect()]
    assert codes("unknown") == [1, 2, 0, 3]
    assert codes("nan") == [2, 3, 0, 1]


def test_scaling_golden(spark):
    rows = spark.createDataFrame([(0, 2.0, 3), (1, 4.0, 3), (2, 6.0, 3)], "row_id long, a double, b int")
    got = [(r["a"], r["b"]) for r in encoding.min_max_scale(rows, ["a", "b"]).orderBy("row_id").collect()]
    assert got == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]


def test_sample_order_golden(spark):
    rows = spark.createDataFrame([(i,) for i in range(1, 11)], "row_id long")
    order = [r["row_id"] for r in sampling.hash_rank(rows).orderBy("rank").collect()]
    assert order == [5, 9, 8, 1, 3, 2, 7, 6, 4, 10]
    assert [r["row_id"] for r in sampling.seeded_sample(rows, 3).collect()] == [5, 9, 8]
    assert sampling.seeded_sample(rows, 0).count() == sampling.seeded_sample(rows, 99).count() == 10


def test_large_sample_takes_the_same_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i,) for i in range(500)], "row_id long")
    small = {r[0] for r in sampling.seeded_sample(rows, 77).collect()}
    monkeypatch.setattr(sampling, "SORTED_LIMIT", 10)
    assert {r[0] for r in sampling.seeded_sample(rows, 77).collect()} == small


def test_folds_and_split_are_even(spark):
    rows = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(203)], "row_id long, label int")
    sizes = sampling.stratified_folds(rows).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r["label"] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    split = {(r["split"], r["label"]): r["count"] for r in sampling.stratified_split(rows).groupBy("split", "label").count().collect()}
    assert split[("test", 0)] + split[("test", 1)] == 41
    assert split[("test", 1)] == 6


def test_class_weights_golden(spark):
    rows = spark.createDataFrame([(i, int(i > 7)) for i in range(10)], "row_id long, label int")
    assert {r["label"]: r["weight"] for r in sampling.class_weights(rows).collect()} == {0: 0.625, 1: 2.5}


def test_reasoning_sizes_golden(spark):
    totals = spark.createDataFrame([(0, 5), (2, 5), (70, 1), (500, 0)], "total_anomalies long, total_normals long")
    got = sampling.reasoning_sample_sizes(totals, 0.1).orderBy("total_anomalies").collect()
    assert [(r["anomaly_samples"], r["normal_samples"]) for r in got] == [(0, 2), (2, 2), (7, 1), (8, 0)]


def test_reasoning_rows_fall_back_to_the_first_five(spark):
    rows = spark.createDataFrame([(i, 7) for i in range(9)], "row_id long, label int")
    assert [r["row_id"] for r in sampling.pick_reasoning_rows(rows).orderBy("sample_order").collect()] == [0, 1, 2, 3, 4]


def test_vector_resize_and_cleaning(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([float("nan"), float("-inf")],)], "v array<double>")
    assert rows.select(arrays.resize_vector(F.col("v"), 4)).first()[0] == [1, 2, 0, 0]
    assert rows.select(arrays.resize_vector(F.col("v"), 1)).first()[0] == [1]
    assert rows.select(arrays.clean_vector(F.col("v"))).collect()[1][0] == [0, 0]


def test_float_text_is_the_shortest_round_trip(spark):
    import random
    rng = random.Random(4)
    values = [0.1 + 0.2, 1e16, 1e15, 123456789012345680.0, 1e-4, 1e-5, 5e-324, -1.5e300, 2.0**-44, 100.0, 0.0, -0.0, 1e22, 1.7976931348623157e308]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-20, 20) for _ in range(3000)] + [rng.random() for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in rows.select(text.float_text(F.col("v"))).collect()]
    wrong = [(g, repr(v)) for g, v in zip(got, values) if g != repr(v) and float(g) != v]
    assert not wrong
    differ = [(g, repr(v)) for g, v in zip(got, values) if g != repr(v)]
    assert len(differ) <= len(values) * 0.002, differ[:5]


def test_number_coercion(spark):
    rows = frame(spark, [" 12 ", "1e3", "x", None, "inf", "-Infinity", "nan", "1d", "0x1", ".5", "5."])
    got = [r[0] for r in rows.orderBy("row_id").select(text.to_number(F.col("v"), rows.schema["v"].dataType)).collect()]
    assert got == [12, 1000, 0, 0, float("inf"), float("-inf"), 0, 0, 0, 0.5, 5.0]


def test_null_words(spark):
    rows = frame(spark, ["NA", "", "null", "n/a", "none", "x", None])
    got = [r[0] for r in rows.orderBy("row_id").select(text.null_if_missing(F.col("v"))).collect()]
    assert got == [None, None, None, None, "none", "x", None]


# ------------------------------------------------------------------ files


def test_csv_positions_and_nulls(spark, tmp_path):
    path = tmp_path / "logs.csv"
    path.write_text("LineId,Date,Time,Level,Component,Content\n" + "".join(
        f"{i},081109,00{i:04d},{'' if i % 3 else 'INFO'},dfs,\"block, \"\"{i}\"\"\"\n" for i in range(50)
    ))
    rows = loaders.load_dataset_unlabeled(spark, str(path), "hdfs", 3).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == [0, 1, 2]
    assert rows[0]["line"] == '081109 000000 INFO dfs block, "0"'
    assert rows[1]["line"] == '081109 000001 dfs block, "1"'


def test_csv_positions_follow_the_file(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("v\n" + "\n".join(str(i) for i in range(200_000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = loaders.read_csv(spark, str(path))
        assert rows.where(F.col("row_id") != F.col("v").cast("long")).count() == 0
        assert rows.count() == 200_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_flow_csv_typed(spark, tmp_path):
    path = tmp_path / "flows.csv"
    path.write_text("id,proto,state,dur,spkts,sttl,label,attack_cat\n1,tcp,FIN,0.5,2,31,0,Normal\n2,udp,,1.0,4,62,1,DoS\n3,arp,INT,0.00001,,31,1,\n")
    numeric = {"id": "long", "dur": "double", "spkts": "double", "sttl": "int", "label": "int"}
    rows = loaders.read_csv(spark, str(path), numeric_columns=numeric)
    got = {r["row_id"]: (r["line"], r["label"]) for r in loaders.load_dataset(spark, rows, "unsw-nb15").collect()}
    assert got == {0: ("1.0 0.0 0.5 2.0", 0), 1: ("2.0 2.0 1.0 4.0", 1), 2: ("0.0 1.0 1e-05 0.0", 1)}
    by_category = loaders.load_dataset(spark, rows.drop("label"), "unsw-nb15").orderBy("row_id").collect()
    assert [r["label"] for r in by_category] == [0, 1, 1]
    leak = loaders.load_unsw_nb15_cleaned(spark, rows, leak_compat=True).first()["features"]
    clean = loaders.load_unsw_nb15_cleaned(spark, rows).first()["features"]
    assert len(leak) == len(clean) + 1
    unlabelled = loaders.load_dataset_unlabeled(spark, rows, "unsw-nb15").orderBy("row_id").first()
    assert unlabelled["line"] == "tcp FIN 0.5 2.0"


def test_unknown_kinds_and_missing_labels(spark):
    rows = traces(spark)
    for call in (loaders.load_dataset, loaders.load_dataset_unlabeled):
        with pytest.raises(ValueError):
            call(spark, rows, "nope")
    with pytest.raises(ValueError):
        loaders.load_unsw_nb15(spark, rows.select("row_id"))
    with pytest.raises(ValueError):
        loaders.load_unsw_nb15_cleaned(spark, rows)


def test_unreadable_templates_are_empty(spark, tmp_path):
    assert loaders.load_log_templates(spark, str(tmp_path / "absent.csv")).count() == 0
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    assert loaders.load_log_templates(spark, str(bad)).count() == 0
    good = tmp_path / "good.csv"
    good.write_text("EventId,EventTemplate\nE1,[*]one[*]\nE1,two\n")
    assert [tuple(r) for r in loaders.load_log_templates(spark, str(good)).collect()] == [("E1", "two")]


def test_combined_results(spark, tmp_path, caplog):
    (tmp_path / "results_a.json").write_text('[{"approach": "a", "acc": 0.5}, {"approach": "b", "acc": 1, "eval_type": "x"}]')
    (tmp_path / "results_b.json").write_text('{"approach": "a", "metadata": {"n": 3}}')
    (tmp_path / "results_c.json").write_text("not json {")
    sinks.save_results(spark.createDataFrame([("c", float("nan"))], "approach string, acc double"), "results", "own", str(tmp_path))
    rows = sinks.combine_results(spark, str(tmp_path))
    assert [(r["approach"], r["n"]) for r in sinks.value_counts(rows, "approach").collect()] == [("a", 2), ("b", 1), ("c", 1)]
    skipped = sinks.skipped_files(spark, str(tmp_path)).collect()
    assert [(r["file"].rsplit("/", 1)[1], r["records"]) for r in skipped] == [("results_c.json", 1)]
    assert "results_c.json" in caplog.text
    assert {r["eval_type"]: r["n"] for r in sinks.value_counts(rows, "eval_type").collect()} == {"x": 1}
    assert set(rows.columns) == {"approach", "acc", "eval_type", "metadata"}
    assert spark.read.option("header", True).csv(str(tmp_path / "combined_results.csv")).count() == 4
    with pytest.raises(ValueError):
        sinks.combine_results(spark, str(tmp_path), "other_*.json")


def test_no_invalid_json_numbers(spark):
    rows = spark.createDataFrame([(float("inf"), [1.0, float("nan")])], "a double, b array<double>")
    assert tuple(sinks.finite_or_null(rows).first()) == (None, [1.0, None])


@pytest.mark.parametrize("n", [1, 50, 1999, 5000])
def test_hash_order_sample_does_not_depend_on_the_filter(spark, n):
    rows = spark.range(2000).withColumnRenamed("id", "row_id")
    want = [r[0] for r in rows.orderBy(sampling.hash_key("row_id"), "row_id").limit(n).collect()]
    assert [r[0] for r in sampling.first_in_hash_order(rows, n).collect()] == want
    assert {r[0] for r in sampling.first_in_hash_order(rows, n, total=10**9).collect()} == set(want)


def test_codes_of_strings_with_a_common_prefix(spark):
    words = [f"commonprefix{i:05d}" for i in range(3000)]
    df = spark.createDataFrame([(w, str(i % 7)) for i, w in enumerate(words)], "a string, b string").repartition(5)
    codes = encoding.category_codes(df, ["a", "b"], "nan")
    got = {(r["column_name"], r["value"]): r["code"] for r in codes.collect()}
    assert got == {("a", w): i for i, w in enumerate(words)} | {("b", str(i)): i for i in range(7)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows make one range
    placed, parts = ranking.place_in_order(df.select(F.col("a").alias("value")), ["value"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts.count() == 4 and parts.agg(F.max("_n")).first()[0] < 1500


def test_float_text_takes_the_nearest_of_equal_length(spark):
    values = [716.77 * 1e18, 853.01 * 1e18, 272088111529.8313 * 1e7 / 3, 2639501520287.9805 * 1e7 / 3, 8.3828550096773e16, 5e-324, 2e-320, 0.1 + 0.2, 1 / 3, None]
    got = [r[0] for r in frame(spark, values, "double").orderBy("row_id").select(text.float_text(F.col("v"))).collect()]
    assert got == [None if v is None else repr(v) for v in values]
    assert got[0] == "7.1677e+20"


def test_enriched_lines_do_not_travel_with_their_tokens(spark, capsys):
    lines = spark.range(20).select(F.col("id").alias("row_id"), F.concat(F.lit("E1 E2 "), F.col("id").cast("string")).alias("line"))
    known = spark.createDataFrame([("E1", "open")], "EventId string, EventTemplate string")
    done = encoding.enrich_tokens(lines, "line", known, map_limit=0)
    assert {(r.row_id, r.line) for r in done.collect()} == {(i, f"open E2 {i}") for i in range(20)}
    done.explain("formatted")
    sent = [part for part in capsys.readouterr().out.split("\n\n") if ") Exchange" in part]
    assert sent and not [part for part in sent if "line#" in part]
