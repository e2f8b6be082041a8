import json

from pyspark.sql import functions as F

from quarrylens.sources import capture


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_gates_and_decoding(spark):
    rows = [("https://x/a.js", "text/javascript"), ("https://x/a.png", ""), ("https://x/a", "image/png"), ("data:x", ""), ("chrome-extension://x", "")]
    df = frame(spark, rows, "url string, mime string")
    assert [r[0] for r in df.select(capture.body_wanted(F.col("url"), F.col("mime"))).collect()] == [True, False, False, False, False]
    assert [r[0] for r in df.select(capture.body_wanted(F.col("url"), F.col("mime"), binary=True)).collect()] == [True, True, True, False, False]
    bodies = frame(spark, [("aGk=", True), ("hello", False), ("*", True)], "b string, e boolean")
    assert [r[0] for r in bodies.select(capture.decoded_body(F.col("b"), F.col("e"), 3)).collect()] == ["hi", "hel", None]
    kinds = frame(spark, [("script",), ("document",), ("header",)], "resource_kind string")
    assert [r[0] for r in capture.scoped(kinds, {"scripts": False}).collect()] == ["document", "header"]
    assert [r[0] for r in kinds.select(capture.capture_allowed(F.col("resource_kind"), {"js": False})).collect()] == [False, True, True]


def test_rules(spark):
    df = frame(spark, [("https://x/API/users", "GET"), ("https://x/a.js", "POST"), ("https://x/z", "GET")], "url string, method string")
    rules = [
        {"id": "off", "kind": "block", "match": "x", "enabled": False},
        {"id": "bad", "kind": "block", "match": "a[", "use_regex": True},
        {"id": "api", "kind": "mock", "match": "api/"},
        {"id": "js", "kind": "block", "match": r"\.js$", "use_regex": True, "method": "POST"},
    ]
    assert [r.rule_id for r in capture.first_rule(df, rules).collect()] == ["api", "js", None]


def test_lookups(spark):
    ex = frame(spark, [(1, "u1", "t1"), (2, "u2", "t2"), (3, "u3", None)], "seq long, url string, target_id string")
    init = frame(spark, [("u1", "b", 2), ("u1", "a", 1)], "url string, initiator string, seq long")
    assert [r.initiator for r in capture.with_initiator(ex, init).orderBy("seq").collect()] == ["a", None, None]
    targets = frame(spark, [("t1", "page", "p"), ("t2", "service_worker", None)], "target_id string, type string, parent_id string")
    assert [r.worker_kind for r in capture.with_worker(ex, targets).orderBy("seq").collect()] == ["iframe", "serviceworker", "unknown"]
    bodies = frame(spark, [("u1", "old", 1), ("u1", "new", 2)], "url string, body string, ingest_seq long")
    assert [r.body for r in capture.with_body(ex, bodies).orderBy("seq").collect()] == ["new", None, None]
    known = bodies.where("ingest_seq = 2").select("url", F.xxhash64("body").alias("hash"))
    assert [r.body for r in capture.changed_only(bodies.select("url", "body"), known).collect()] == ["old"]


def test_source_maps(spark):
    body = json.dumps({"version": 3, "sources": ["src/a.ts", "src/b.ts", "c"], "sourcesContent": ["x" * 11, None, "short"]})
    assert [(r.path, r.content) for r in capture.source_files(frame(spark, [("m", body), ("bad", "{")], "url string, body string")).collect()] == [("src/a.ts", "x" * 11)]
    res = frame(spark, [("https://x/a.js", "script", False), ("https://x/a.js.map", "source-map", False), ("https://x/b.js", "script", True)], "url string, kind string, has_source_map boolean")
    assert {r.candidate for r in capture.unmapped_scripts(res).collect()} == {"https://x/a.map", "https://x/maps/a.js.map"}


def test_files_and_tokens(spark, tmp_path):
    (tmp_path / "app.js").write_text("let a")
    (tmp_path / "p.png").write_bytes(b"\x89PNG")
    out = {r.kind: r for r in capture.read_resources(spark, str(tmp_path), base="https://x/").collect()}
    assert out["script"].body == "let a" and out["script"].url == "https://x/app.js" and out["media-meta"].body is None
    tokens = frame(spark, [("k", "AKIA" + "IOSFODNN7QLMPLWX", "storage")], "key string, val string, source string")
    assert capture.harvested_findings(tokens).first().rule == "aws_access_key"


def test_detail_and_names(spark):
    schema = "seq long, url string, method string, status int, req_headers map<string,string>, req_body string, resp_body string"
    ex = frame(spark, [(1, "https://x/api/login?c=1", "POST", 200, {"Authorization": "b"}, '{"u":1}', '{"u":1,"t":2}')], schema)
    mined = frame(spark, [("/api/login", "POST", ["c"], ["u", "p"])], "url string, method string, params array<string>, body_keys array<string>")
    row = capture.endpoint_detail(ex, mined).first()
    assert (row.schema_url, row.badges, row.response_only) == ("/api/login", "auth", ["t"])
    assert mined.select(capture.replay_template(F.col("body_keys"))).first()[0] == '{"u":"","p":""}'
    found = frame(spark, [("fw-wordpress", "WordPress 6.4")], "rule string, label string")
    assert [r.name for r in capture.framework_names(found, frame(spark, [("https://x/_next/a",)], "url string")).collect()] == ["Next.js", "WordPress"]
