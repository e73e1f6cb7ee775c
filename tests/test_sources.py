"""Readers, parsers, sinks and streams on small files."""

import json

from pyspark.sql import functions as F

from conftest import rows
from evidence_spark.functions.records import variant
from evidence_spark.operators import rules as D
from evidence_spark.sources import readers as S
from evidence_spark.sources import store as B
from evidence_spark.sources import writers as K
from evidence_spark.streaming import ingest as W


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    return str(tmp_path / name)


def lines(spark, text):
    return spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "path string, pos int, line string")


def test_route(spark):
    files = spark.createDataFrame([("/a/x.evtx", b"ElfFile"), ("/a/$MFT", b"FILE0"), ("C:\\b\\ntuser.dat", b"regf"), ("/z/log_1.txt", b"")], "path string, content binary")
    parsers = spark.createDataFrame([("ext", "extension", ".evtx,.x"), ("name", "file_name", "$MFT"), ("magic", "magic_number", "72 65 67 66"), ("start", "startswith", "log_"), ("rex", "regex", r"log_\d\.txt")], "parser_name string, categorization_type string, categorization_values string")
    assert rows(S.route_files(files, parsers)) == [("/a/$MFT", "name"), ("/a/x.evtx", "ext"), ("/z/log_1.txt", "rex"), ("/z/log_1.txt", "start"), ("C:\\b\\ntuser.dat", "magic")]


def test_routes_by_many_rules(spark, monkeypatch):
    """Rules of each kind, of many lengths: the pairs of plain comparisons, with and without broadcasts."""
    import re as R

    names = [f"{a}{i}.{e}" for i, (a, e) in enumerate((a, e) for a in ("log_", "Log", "x") for e in ("evtx", "txt", "tar.gz", ""))]
    files = [(f"/d/{n}" if i % 2 else f"C:\\d\\{n}", bytes([i, 17 * i % 256, 3])) for i, n in enumerate(names)] + [("/d/none", None), ("", b"")]
    rules = [("e", "extension", ".evtx,gz,4.txt, x"), ("n", "file_name", f"{names[0]},{names[5]}"), ("s", "startswith", "log,Log1,x"), ("m", "magic_number", "00,01 11 03,0222,030303030303"), ("r", "regex", r"[a-z]+_\d\..*,x.*"), ("bad", "other", "x"), ("none", "extension", " , ")]

    def fits(path, content, kind, v):
        base = path.replace("\\", "/").rsplit("/", 1)[-1]
        v = v.strip()
        tests = {"extension": base.endswith(v), "file_name": base == v, "startswith": base.startswith(v), "regex": kind == "regex" and R.fullmatch(v, base), "magic_number": content is not None and content.hex().startswith(v.replace(" ", "").lower())}
        return bool(v) and bool(tests.get(kind))

    want = sorted({(p, name) for p, c in files for name, kind, values in rules for v in values.split(",") if fits(p, c, kind, v)})
    df, parsers = spark.createDataFrame(files, "path string, content binary"), spark.createDataFrame(rules, "parser_name string, categorization_type string, categorization_values string")
    for most in (10_000, 0):
        monkeypatch.setattr(S, "BROADCAST_RULES", most)
        assert sorted(tuple(r) for r in S.route_files(df, parsers).collect()) == want
    assert len(want) > 12 and S.route_files(df, parsers.limit(0)).count() == 0


def test_kjson_and_jsonl(spark, tmp_path):
    p = put(tmp_path, "a.kjson", '{"Data":{"@timestamp":"t","n":1},"data_source":"s","data_type":"d","data_path":"/p","machine":"M"}\nnot json\n\n[1]\n')
    out = S.read_kjson(spark, p)
    assert rows(out.where("not bad"), "data", "data_type") == [('{"@timestamp":"t","n":1}', "d")]
    assert rows(out.where("bad"), "reject") == [("[1]",), ("not json",)]
    assert S.read_jsonl(spark, p).where("bad").count() == 1


def test_csv(spark, tmp_path):
    assert rows(S.read_csv_records(spark, put(tmp_path, "a.csv", 'a,b\n1,"x ""y"""\n2\n'))) == [("1", 'x "y"'), ("2", "")]


def test_w3c(spark, tmp_path):
    text = "#Software: x\r\n#Fields: date time cs(User-Agent) s-ip\r\n2024-01-01 00:00:01 ua 1.1.1.1 more\r\n#Fields: time date\r\n00:00:02 2024-01-02\r\n"
    got = S.read_w3c_log(spark, put(tmp_path, "u.log", text)).orderBy("pos").collect()
    assert got[0]["fields"] == {"date": "2024-01-01", "time": "00:00:01", "cs_user_agent": "ua", "s_ip": "1.1.1.1", "field4": "more"}
    assert [r["@timestamp"] for r in got] == ["2024-01-01T00:00:01", "2024-01-02T00:00:02"]


def test_exchange(spark, tmp_path):
    text = '\ufeff#Fields: DateTime,a,b\n2024-01-01T00:00:00Z,"x,y","q ""z"""\n,1,2\n2024-01-02T00:00:00Z,1,2,3\n'
    got = S.read_exchange_log(spark, put(tmp_path, "e.log", text)).orderBy("pos").collect()
    assert [r["fields"] for r in got] == [{"DateTime": "2024-01-01T00:00:00Z", "a": "x,y", "b": 'q "z"'}, {"DateTime": "2024-01-02T00:00:00Z", "a": "1", "b": "2", "field3": "3"}]


def test_trace(spark):
    out = S.parse_trace_log(lines(spark, "  info 2021-01-01 10:00:00.123   text x\ncontinued\n  "))
    assert rows(out, "level", "@timestamp", "message") == [("info", "2021-01-01T10:00:00.123", "text x"), (None, "1700-01-01T00:00:00", "continued")]


def test_sccm(spark):
    out = S.parse_sccm_log(lines(spark, '<![LOG[a b]LOG]!><time="10:11:12.123-180" date="02-03-2021" component="c">'))
    assert rows(out, "message", "@timestamp") == [("a b", "2021-02-03T10:11:12.123")] and out.first()["fields"]["component"] == "c"


def test_netlogon(spark):
    text = "01/02 03:04:05 [LOGON] [77] DOM: SamLogon: Transitive Network logon of DOM\\bob from SRC (via DST) Entered\n01/02 03:04:06 [LOGON] [77] DOM: SamLogon: Transitive Network logon of DOM\\bob from SRC (via DST) Returns 0xC000006A\nother"
    got = rows(S.parse_netlogon(lines(spark, text)), "pid", "user", "source", "target", "is_request", "code")
    assert got == [("77", "bob", "SRC", "DST", False, "0xC000006A"), ("77", "bob", "SRC", "DST", True, None)]


def test_mft(spark):
    out = S.normalize_mft(lines(spark, "1,2024-01-01 00:00:00,NoFNRecord,/a/b,c\n1,2"), ["Rec", "StandardInfoCreated", "FileNameCreated", "FullPath"])
    r = out.first()
    assert out.count() == 1 and (r["SICreated"], r["FNCreated"], r["FullPath"], r["@timestamp"]) == ("2024-01-01T00:00:00", "1700-01-01T00:00:00", "\\a\\b,c", "1700-01-01T00:00:00")


def test_mft_changes_its_own_columns_only(spark):
    out = S.normalize_mft(lines(spark, "a b/c,,2024-01-01 00:00:00,x y,/p/q,r"), ["SIFlags", "StandardInfoLastAccess", "FileNameCreated", "FNName", "FullPath"]).first()
    assert (out["SIFlags"], out["SILastAccess"], out["FNCreated"], out["FNName"], out["FullPath"]) == ("a b/c", "1700-01-01T00:00:00", "2024-01-01T00:00:00", "x y", "\\p\\q,r")


def test_flows(spark):
    df = spark.createDataFrame([(1, 2, 1500, 2500), (1, 2, None, None)], "first_seen long, last_seen long, first_seen_ms long, last_seen_ms long")
    assert rows(S.normalize_flows(df), "@timestamp") == [("1970-01-01T00:00:01.000",), ("1970-01-01T00:00:01.500",)]


def test_blocks(spark):
    text = "remaining client pid: 12 (/a)\nremaining client pid: 13 (/b)\nSIGTERM: [100]\nremaining client pid: 14 (/c)"
    assert rows(S.parse_shutdown_log(lines(spark, text)), "pid", "client") == [("12", "/a"), ("13", "/b")]
    text = "    android.intent.X:\n        1a com.bad/.R\n        2b com.google.y/.S\n    other:\n        3c com.z/.T"
    assert rows(S.parse_receivers(lines(spark, text), "android.intent.X"), "id", "receiver") == [("1a", "com.bad/.R"), ("2b", "com.google.y/.S")]


def test_values_are_carried_over_blocks(spark, monkeypatch):
    """Blocks of a few lines: the nearest value may stand several blocks away."""
    monkeypatch.setattr(S, "BLOCK_LINES", 3)
    data = [(p, i, f"v{i}" if i % k == k - 1 else None) for p, k in (("a", 7), ("b", 2), ("c", 100)) for i in range(40)]
    df = spark.createDataFrame(data, "path string, pos long, x string")
    for after in (True, False):
        got = {(r["path"], r["pos"]): r["n"] for r in S.nearest_value(df, F.col("x"), "n", after).collect()}
        for p, i, _ in data:
            mine = [(q, v) for path, q, v in data if path == p and v and (q >= i if after else q <= i)]
            assert got[p, i] == ((min if after else max)(mine)[1] if mine else None)


def test_iis_config(spark, tmp_path):
    xml = '<configuration><sites><site name="s" id="1"><application path="/app" applicationPool="p"><virtualDirectory path="/" physicalPath="C:\\x"/><virtualDirectory path="/v" physicalPath="D:\\y"/></application></site></sites></configuration>'
    assert rows(S.read_iis_config(spark, put(tmp_path, "a.config", xml)), "site", "virtual_path", "physical_path") == [("s", "/app/", "C:\\x"), ("s", "/app/v", "D:\\y")]


def test_items(spark):
    df = spark.createDataFrame([([("2024-01-01T00:00:00Z", None, "n")],)], "items array<struct<t:string,a:string,b:string>>")
    spec = {"items": "items", "type": "file", "timestamp": "t", "format": "yyyy-MM-dd'T'HH:mm:ssX", "message": "[{a|b}] ok"}
    assert rows(S.render_items(df, [spec])) == [("file", "2024-01-01T00:00:00", "[n] ok")]


def test_report_memory_and_ps(spark):
    df = spark.createDataFrame([("Version=1\r\nEventTime=116444736000000000\r\nTargetAppId=W:x!0000" + "a" * 40 + "!y\r\nVersion=2",)], "text string")
    r = S.parse_kv_report(df).first()
    assert (r["@timestamp"], r["sha1"], r["fields"]["Version"]) == ("1970-01-01T00:00:00.000000", "a" * 40, "1")
    mem = spark.createDataFrame([("2024-01-01 00:00:00", 255, 1, "x"), (None, 16, None, "y")], "CreateTime string, Offset long, Handle int, __children string")
    assert rows(S.normalize_memory_table(mem, "CreateTime", ["Offset"], ["Handle"]), "Offset", "@timestamp") == [("0xff", "2024-01-01T00:00:00")]
    ps = "USER PID PPID VSZ RSS WCHAN ADDR S NAME\nroot 1 0 10 20 w 0 S init\nroot 2 0 10 20 0 S kthread"
    assert rows(S.parse_ps(lines(spark, ps)), "pid", "wchan", "name") == [("1", "w", "init"), ("2", "", "kthread")]


def test_line_records(spark, tmp_path):
    assert rows(S.read_line_records(spark, put(tmp_path, "h.txt", " dir \n\nls\n")), "command") == [("dir",), ("ls",)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "c", "t1", "{}"), ("2", "c", "t2", "{}"), (None, "c", "t2", "{}")], "record_id string, case_id string, data_type string, data string")
    assert K.write_records(df, str(tmp_path / "store")) == {"pushed": 2, "failed": 1}
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    K.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    K.export_columns(df, ["record_id"], str(tmp_path / "x"))
    assert spark.read.csv(str(tmp_path / "x"), header=True).columns == ["record_id"]
    alerts = spark.createDataFrame([("t", "1", "r", 5, 'a "b"', "ref", ["m", "n"], "{}")], "ts string, record_id string, rule_name string, score int, description string, reference string, matched array<string>, returned string")
    K.write_alerts_csv(alerts, str(tmp_path / "a"))
    assert spark.read.csv(str(tmp_path / "a"), header=True, escape='"').first()["matched"] == "m; n"
    line = spark.range(1).select(K.body_line(F.lit("a|b"), F.lit(None).cast("timestamp"), F.timestamp_seconds(F.lit(5)), F.timestamp_seconds(F.lit(6)), F.timestamp_seconds(F.lit(7)))).first()[0]
    assert line == "|a_b||||||0|5|6|7"


def test_one_large_type_is_split(spark, tmp_path):
    """A hot case and type is written by many tasks, a small one by one."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 60_000, numPartitions=12).select(F.col("id").cast("string").alias("record_id"), F.lit("c").alias("case_id"), F.when(F.col("id") == 7, "small").otherwise("hot").alias("data_type"), F.concat(F.lit("{}"), F.sha1(F.col("id").cast("string"))).alias("data"))
        assert K.write_records(df, str(tmp_path / "store")) == {"pushed": 60_000, "failed": 0}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = spark.read.parquet(str(tmp_path / "store")).select("data_type", F.input_file_name().alias("f")).groupBy("data_type").agg(F.count_distinct("f").alias("files"), F.count("*").alias("n"))
    n = {r["data_type"]: (r["files"], r["n"]) for r in got.collect()}
    assert n["small"] == (1, 1) and n["hot"][1] == 59_999 and n["hot"][0] > 4


def envelopes(n, start=0):
    return "".join(json.dumps({"Data": {"@timestamp": f"2024-01-01T00:00:{i:02d}", "k": i % 3}, "data_source": "s", "data_type": "d", "data_path": "/p", "machine": "M"}) + "\n" for i in range(start, start + n))


def test_stream_equals_batch(spark, tmp_path):
    src, dst, ck = (str(tmp_path / x) for x in ("src", "dst", "ck"))
    (tmp_path / "src").mkdir()
    put(tmp_path / "src", "a.kjson", envelopes(10))
    rules = [D.Rule("Zero", include={"k": "0"}, description="d")]
    W.stream_ingest(spark, src, dst, ck, "case", rules).awaitTermination()
    put(tmp_path / "src", "b.kjson", envelopes(10, 10) + "broken\n")
    W.stream_ingest(spark, src, dst, ck, "case", rules).awaitTermination()
    got = spark.read.parquet(dst)
    assert got.count() == 20 and got.select("record_id").distinct().count() == 20
    assert got.where("rule_match.rule_name = 'Zero'").count() == 7
    put(tmp_path / "src", "c.kjson", envelopes(50, 20))
    W.stream_ingest(spark, src, dst, ck, "case", chunk=8).awaitTermination()
    files = spark.read.parquet(dst).groupBy(F.input_file_name().alias("f")).count()
    assert files.agg({"count": "max"}).first()[0] <= 10 and spark.read.parquet(f"{dst}/batch=2").count() == 50


def test_stream_scan_and_correlation(spark, tmp_path):
    (tmp_path / "src").mkdir()
    put(tmp_path / "src", "a.kjson", envelopes(20))
    stream = W.read_stream(spark, str(tmp_path / "src"), "case")
    rules = [D.Rule("Zero", include={"k": "0"}, description="d"), D.Rule("One", include={"k": "1"}, description="d")]
    q = W.stream_scan(stream, rules).writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("alerts").groupBy("rule_name").count().orderBy("rule_name").collect()[0]["count"] == 7
    a, b = (W.rule_stream(W.read_stream(spark, str(tmp_path / "src"), "case"), r) for r in rules)
    q = W.stream_correlate(a, b, 2000).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = S.read_kjson(spark, str(tmp_path / "src")).withColumn("v", variant("data"))
    t = batch.select(F.unix_seconds(F.try_variant_get("v", "$['@timestamp']", "timestamp")).alias("t"), F.try_variant_get("v", "$.k", "int").alias("k"))
    want = t.where("k = 0").select(F.col("t").alias("x")).crossJoin(t.where("k = 1").select("t")).where("abs(x - t) < 2").count()
    assert spark.table("pairs").count() == want > 0


def machine(line):
    """Cells as the log's own reader makes them, a character at a time."""
    out, elem, inside, quoted = [], "", False, False
    for c in line:
        if c == '"':
            if quoted and elem:
                elem, quoted = elem + '"', False
            else:
                inside, quoted = not inside, True
            continue
        quoted = False
        if c == "," and not inside:
            out.append(elem)
            elem = ""
        else:
            elem += c
    return [*out, elem]


def test_quotes_anywhere_in_a_cell(spark, monkeypatch):
    import itertools

    texts = ["".join(x) for n in range(7) for x in itertools.product('",a', repeat=n)] + ['x="p,q",r', 'a,"' + "b, " * 400_000 + '",c', '"' + 'x""' * 700 + '",y', None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for quotes in (256, 1):
        monkeypatch.setattr(S, "QUOTES", quotes)
        for r in df.select("t", S.split_csv(F.col("t")).alias("cells")).collect():
            assert r["cells"] == (None if r["t"] is None else machine(r["t"])), r["t"][:80]


def test_names_beyond_the_header_and_names_given_twice(spark):
    text = "#Fields: date time a a\n2024-01-01 00:00:00 1 2 3 4\n2024-01-01 00:00:01 1"
    got = S.parse_w3c(lines(spark, text)).orderBy("pos").collect()
    assert [r["fields"] for r in got] == [{"date": "2024-01-01", "time": "00:00:00", "a": "2", "field4": "3", "field5": "4"}, {"date": "2024-01-01", "time": "00:00:01", "a": "1"}]


def test_receiver_blocks(spark):
    text = "  android.A:\n        1 com.x/.R\n        2 com.google.android.gms/.G\n        3 com.google.android.apps.m/.M\n\n        4 com.y/.R\n        android.B:\n        5 com.z/.R z\n  other\n        6 com.w/.R"
    got = rows(S.parse_receivers(lines(spark, text), ["android.A", "android.B"]), "activity", "id", "package_name", "receiver")
    assert got == [("android.A", "1", "com.x", "com.x/.R"), ("android.A", "3", "com.google.android.apps.m", "com.google.android.apps.m/.M"), ("android.B", "5", "com.z", "com.z/.R")]


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("part-*.parquet")}


def test_edits_write_touched_partitions_only(spark, tmp_path):
    path = tmp_path / "case"
    data = [(str(i), "c", f"M{i % 3}", ["01", "1", "a/b=c", None][i % 4], json.dumps({"n": i})) for i in range(24)]
    df = spark.createDataFrame(data, "record_id string, case_id string, machine string, data_type string, data string")
    K.write_records(df, str(path))
    before = files_of(path)
    assert B.delete_in_store(spark, str(path), (F.col("machine") == "M1") & (F.col("data_type") == "01")) == 1
    left = B.read_store(spark, str(path))
    assert rows(left, "record_id", "data_type") == sorted([(r[0], r[3]) for r in data if not (r[2] == "M1" and r[3] == "01")], key=repr)
    after = files_of(path)
    assert {k for k in before if "data_type=01" not in k} == {k for k in after if "data_type=01" not in k} and all(after[k] == before[k] for k in before if "data_type=01" not in k)
    # the whole of a partition, the one without a type
    assert B.delete_in_store(spark, str(path), F.col("data_type").isNull()) == 1
    assert B.read_store(spark, str(path)).where("data_type is null").count() == 0
    new = spark.createDataFrame([("2", "moved"), ("3", None), ("99", "none")], "record_id string, value string")
    assert B.update_in_store(spark, str(path), new, "machine") == 1
    got = {r["record_id"]: r["machine"] for r in B.read_store(spark, str(path)).collect()}
    assert got["2"] == "moved" and got["6"] == "M0" and len(got) == 24 - 6 - 2
    assert B.delete_in_store(spark, str(path), F.lit(False)) == 0 and not list(path.glob("_edits/*"))


def test_an_edit_that_breaks_off_is_finished(spark, tmp_path, monkeypatch):
    path = tmp_path / "case"
    df = spark.createDataFrame([(str(i), "c", "M", "ab"[i % 2], "{}") for i in range(10)], "record_id string, case_id string, machine string, data_type string, data string")
    K.write_records(df, str(path))
    real = B._apply

    def broken(*a):
        raise OSError("lost")

    monkeypatch.setattr(B, "_apply", broken)
    try:
        B.delete_in_store(spark, str(path), F.col("record_id") == "4")
    except OSError:
        pass
    monkeypatch.setattr(B, "_apply", real)
    import shutil

    shutil.rmtree(path / "case_id=c" / "data_type=a")  # the worst moment: the old partition is gone, the new one not there
    assert B.recover_store(spark, str(path)) == 1
    assert rows(B.read_store(spark, str(path)), "record_id") == [(str(i),) for i in range(10) if i != 4]
    assert B.recover_store(spark, str(path)) == 0


def test_status_store(spark, tmp_path):
    cols = "machine string, file_path string, parser_name string, status string, start_time int, message string, task_id string, disabled boolean"
    old = spark.createDataFrame([(m, f, "p", "queued", 1, None, "t", False) for m in ("m1", "m2") for f in ("a", "b")], cols)
    path = tmp_path / "status"
    B.create_status_store(old, str(path))
    before = files_of(path)
    new = spark.createDataFrame([("m1", "a", "p", "done", 2, None, "t", False), ("m3", "x", "p", "queued", 1, None, "t", False)], cols)
    assert B.upsert_in_store(spark, str(path), new) == 2
    assert rows(B.read_store(spark, str(path), B.STATUS_KEYS), "machine", "file_path", "status") == [("m1", "a", "done"), ("m1", "b", "queued"), ("m2", "a", "queued"), ("m2", "b", "queued"), ("m3", "x", "queued")]
    assert B.disable_in_store(spark, str(path), "m1", "b", "p", True) == 1
    assert rows(B.read_store(spark, str(path), B.STATUS_KEYS).where("disabled"), "machine", "file_path") == [("m1", "b")]
    assert all(t == before[k] for k, t in files_of(path).items() if "machine=m2" in k)


def test_stream_of_three_rules_equals_batch(spark, tmp_path):
    """Records in several files, in order of time: the stream finds the batch's sets and lets state go."""
    src = tmp_path / "src"
    src.mkdir()
    record = lambda i, ms, t: json.dumps({"Data": json.dumps({"@timestamp": f"2024-01-01T{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}", "t": t, "n": i}), "data_source": "s", "data_type": "x", "data_path": f"/{i}", "machine": "M"})
    times = [i * 700 + (i * 37 % 11) * 50 for i in range(60)] + [3_600_000 * 2 + i * 700 for i in range(30)]
    for n in range(3):
        put(src, f"{n}.kjson", "\n".join(record(i, ms, "abc"[i % 3]) for i, ms in enumerate(times) if i // 30 == n))
    private = {t: D.Rule(t, False, include={"t": t}, returns=["n"]) for t in "abc"}
    rule = D.Rule("R", calls=["a", "b", "c"], within=1500, description="why", reference="where")
    stream = W.read_stream(spark, str(src), "case", max_files=1)
    q = W.stream_correlate_rules(stream, rule, private, late="1 minute").writeStream.format("memory").queryName("triples").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = rows(spark.table("triples"), "record_ids", "description", "reference", "returned")
    records = spark.read.text(str(src)).select(F.from_json("value", W.KJSON).alias("r")).select("r.*")
    records = records.select(F.sha2(F.concat_ws("\u0001", "machine", "data_type", "data_path", "Data"), 256).alias("record_id"), "machine", "data_type", F.col("Data").alias("data"))
    want = rows(D.correlate(records, rule, private, keys=["machine"]), "record_ids", "description", "reference", "returned")
    assert got == want and len(want) > 20
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress]
    assert held[-1] < max(held)


def _crowd(spark, tmp_path, n):
    """Streams of ``n`` records of each of three kinds on one machine, 100 ms apart."""
    (tmp_path / "src").mkdir()
    record = lambda i, t: json.dumps({"Data": json.dumps({"@timestamp": f"2024-01-01T00:{i // 600:02d}:{i // 10 % 60:02d}.{i % 10}00", "t": t}), "data_source": "s", "data_type": "x", "data_path": f"/{i}", "machine": "M"})
    put(tmp_path / "src", "a.kjson", "\n".join(record(i, t) for i in range(n) for t in "abc"))
    return W.read_stream(spark, str(tmp_path / "src"), "case")


def test_stream_pairs_meet_in_time_buckets(spark, tmp_path):
    stream = _crowd(spark, tmp_path, 300)
    a, b = (W.rule_stream(stream, D.Rule(t, include={"t": t})) for t in "ab")
    pairs = W.stream_correlate(a, b, 500)
    assert "_bucket" in pairs._jdf.queryExecution().analyzed().toString()
    want = sum(abs(i - j) < 5 for i in range(300) for j in range(300))
    assert W.drain(pairs).count() == want


def test_state_of_a_stream_of_rules_holds_events_only(spark, tmp_path):
    """Far more sets than records: the state does not grow with them."""
    private = {t: D.Rule(t, False, include={"t": t}) for t in "abc"}
    rule = D.Rule("R", calls=["a", "b", "c"], within=2_000)
    stream = _crowd(spark, tmp_path, 300)
    q = W.stream_correlate_rules(stream, rule, private).writeStream.format("memory").queryName("crowd").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = sum(max(i, j, k) - min(i, j, k) < 20 for i in range(300) for j in range(max(0, i - 20), min(300, i + 20)) for k in range(max(0, i - 20), min(300, i + 20)))
    assert spark.table("crowd").count() == want > 100_000
    assert max(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress) < 1_000


def test_blocks_are_expanded_by_event(spark):
    """All sets of a block, for two to four rules; its first events are loops of their own, and no map is made where one value is read."""
    import itertools
    import random
    import re

    rng = random.Random(4)
    event = "array<struct<ms:bigint,id:string,ret:string>>"
    for n in (2, 3, 4):
        sides = [sorted(rng.randint(0, 3000) for _ in range(12)) for _ in range(n)]
        row = ("M", *[[(ms, f"{k}.{i}", f"r{k}.{i}") for i, ms in enumerate(side)] for k, side in enumerate(sides)])
        blocks = spark.createDataFrame([row], ", ".join(["machine string", *[f"e{k} {event}" for k in range(n)]]))
        rule = D.Rule("R", calls=list("abcd")[:n], within=900)
        out = W.block_alerts(blocks, rule).select("record_ids", F.unix_millis("ts"), F.col("returned")["b"])
        want = [([f"{k}.{i}" for k, i in enumerate(x)], min(sides[k][i] for k, i in enumerate(x)), f"r1.{x[1]}") for x in itertools.product(range(12), repeat=n) if max(sides[k][i] for k, i in enumerate(x)) - min(sides[k][i] for k, i in enumerate(x)) < 900]
        assert rows(out) == sorted(want, key=repr) and want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"map_from_arrays|map\(", plan)
        assert len(set(re.findall(r"(\*\(\d+\) )Generate explode", plan))) == max(1, n - 1)


def test_exchange_line_is_split_once(spark):
    df = lines(spark, '#Fields: DateTime,id,note\n2024-01-01T00:00:00,1,"a, ""b"" c"\n,2,x\n2024-01-01T00:00:01,3')
    out = S.parse_exchange(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(split(") == 1
    assert [(r["@timestamp"][-1], dict(r["fields"])["id"], dict(r["fields"]).get("note")) for r in out.orderBy("pos").collect()] == [("0", "1", 'a, "b" c'), ("1", "3", None)]
