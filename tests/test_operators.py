import base64
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylens.functions.urls import url_resolve
from quarrylens.operators import api, dsl, exposures, extract, graph, mining, search, secrets, tables
from quarrylens.sources import exports, har


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).coalesce(1)


# --- filter language ---


def test_dsl_parse():
    assert dsl.parse('method:GET -status:>=500 "two words" host:"a b" -x foo:bar') == [
        dsl.Term("method", "GET"),
        dsl.Term("status", ">=500", True),
        dsl.Term("", "two words"),
        dsl.Term("host", "a b"),
        dsl.Term("", "x", True),
        dsl.Term("", "foo:bar"),
    ]


ROWS = [(1, "GET", 200, "a.x"), (2, "POST", 500, "b.x"), (3, "GET", None, None), (4, None, 404, "c.y")]


@pytest.mark.parametrize(
    ("text", "ids"),
    [("-status:500", [1, 3, 4]), ("status:>=400", [2, 4]), ("status:x", []), ("host:*.x", [1, 2]), ("-host:*.x", [3, 4]), ("method:get", [1, 3]), ("has:error", [2, 4]), ("has:nothing", []), ("host:", []), ("c.y", [4]), ("", [1, 2, 3, 4])],
)
def test_dsl_filters(spark, text, ids):
    df = frame(spark, ROWS, "id int, method string, status int, host string").withColumn("is_error", F.col("status") >= 400)
    assert sorted(r.id for r in dsl.apply(df, text).collect()) == ids


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet='ab:*"- status<>=0123', max_size=20))
def test_dsl_always_parses(text):
    assert all(isinstance(t.value, str) and t.value for t in dsl.parse(text))


# --- tables ---


def test_counts_and_groups(spark):
    df = frame(spark, [("a",), ("a",), ("",), (None,), ("b",)], "k string")
    assert [tuple(r) for r in tables.count_by(df, "k").collect()] == [("a", 2), ("other", 2), ("b", 1)]
    urls = frame(spark, [("https://API.X.example:8080/a",), ("/rel",), ("https://first.test/",), ("https://api.x.example/b",)], "url string")
    assert [r.host for r in tables.group_by_host(urls, first_party="first.test").collect()] == ["first.test", "api.x.example", "(relative)"]
    capped = tables.capped_per(frame(spark, [("a", i) for i in range(5)], "k string, n int"), ["k"], [F.col("n")], 2).collect()
    assert [(r.n, r.more) for r in capped] == [(0, 3), (1, 3)]


def test_retention_and_pressure(spark):
    df = frame(spark, [("c", 10, i) for i in range(10)], "category string, bytes long, seq long")
    out = {r.seq: r.kept for r in tables.retention(df, 35).collect()}
    assert [out[i] for i in range(10)] == [False] * 7 + [True] * 3
    assert [r[0] for r in spark.range(3).select(tables.pressure(F.col("id") * 45, F.lit(90))).collect()] == ["ok", "ok", "full"]


# --- extraction ---

JS = """import('./lazy.js'); fetch("/api/models?debug=1"); const a = "/dashboard/" + "settings"; // "/not/this"
axios.get(`/users/${id}/posts`); el.innerHTML = x; eval(y); new Function('z');
const q = `query GetUser($id: ID!) { user }`; x = {baseURL: "https://api.x.test"}; y = "v1/users";
path: "/login", method: "post"
//# sourceMappingURL=app.js.map"""


def test_js_units(spark):
    units = extract.js_units(frame(spark, [("u", JS)], "url string, body string")).collect()
    found = {(u.kind, u.text) for u in units}
    for wanted in [("dynamic-import", "./lazy.js"), ("fetch-target", "/api/models?debug=1"), ("endpoint", "/api/models?debug=1"), ("route", "/dashboard/settings"), ("param", "debug"), ("sourcemap-ref", "app.js.map"), ("graphql-op", "graphql:query:GetUser"), ("route", "/login"), ("endpoint", "https://api.x.test/v1/users")]:
        assert wanted in found, wanted
    assert ("route", "/not/this") not in found
    assert {u.extra for u in units if u.kind == "sink"} == {"innerHTML", "eval", "Function"}
    assert next(u.line for u in units if u.kind == "sourcemap-ref") == 5


def test_html_css_json_units(spark):
    html = '<a href="/models">x</a><a href="javascript:1">n</a><script src="/app.js"></script><iframe src="https://f.test/"></iframe><meta name="d" content="c"><form action="/go"><input name="q"></form><p>Hello <b>there</b></p>'
    found = {(r.kind, r.text) for r in extract.html_units(frame(spark, [("u", html)], "url string, html string")).collect()}
    assert {("dom-link", "/models"), ("route", "/models"), ("script", "/app.js"), ("iframe", "https://f.test/"), ("meta-tag", "d: c"), ("form-input", "q"), ("dom-text", "x n Hello there")} <= found
    css = {(r.kind, r.text) for r in extract.css_units(frame(spark, [("u", "@import 'b.css'; .card{background:url(/i.png)}")], "url string, body string")).collect()}
    assert {("css-import", "b.css"), ("css-reference", "/i.png"), ("css-selector", ".card")} <= css
    body = json.dumps({"models": [{"name": f"m{i}"} for i in range(5)], "method": "getUser", "next": "/api/v2/x", "n": None})
    units = extract.json_units(frame(spark, [("u", body), ("s", 'data: {"status":"active"}\n\nnoise\n{"id":7}')], "url string, body string")).collect()
    assert ("m4", "models[4].name") in {(u.text, u.extra) for u in units if u.kind == "json-string"}
    assert {"status: active", "id: 7", "method: getUser"} <= {u.text for u in units if u.kind == "json-pair"}
    assert {u.text for u in units if u.kind in ("endpoint", "jsonrpc-method")} == {"/api/v2/x", "getUser"}
    spec = json.dumps({"paths": {"/pets": {"get": {}, "post": {}, "x-note": 1}}})
    assert {(r.method, r.path) for r in extract.declared_endpoints(frame(spark, [("u", spec)], "url string, body string")).collect()} == {("GET", "/pets"), ("POST", "/pets")}


def test_dispatch_and_lines(spark):
    rows = [("a.json", "application/json", '{"k":1}'), ("b.css", "text/css", ".abc{}"), ("c", "text/html", '<a href="/x">y</a>'), ("d.js", "", 'fetch("/api/z")'), ("e.txt", "text/plain", "a line\n\nx")]
    units = extract.units(frame(spark, rows, "url string, mime string, body string")).collect()
    assert {(u.resource_url, u.kind) for u in units} >= {("a.json", "json-pair"), ("b.css", "css-selector"), ("c", "dom-link"), ("d.js", "fetch-target"), ("e.txt", "text-line")}
    assert [u.text for u in units if u.resource_url == "e.txt"] == ["a line"]


def test_mining():
    calls = mining.api_calls('fetch("/login?client=a&redirect=b", {method: "POST", body: JSON.stringify({username, password: p, mfaCode: {a: 1}})}); axios.post("/x", {name: 1, tags: [1]});')
    assert calls[0] == {"method": "POST", "url": "/login?client=a&redirect=b", "params": ["client", "redirect"], "body_keys": ["username", "password", "mfaCode"]}
    assert calls[1]["method"] == "POST" and calls[1]["body_keys"] == ["name", "tags"]
    ops = mining.graphql_operations("query A($id: ID!) { a { b } } mutation B { c } fragment F on T { d }")
    assert [(o["kind"], o["name"], o["variables"]) for o in ops] == [("query", "A", ["id: ID!"]), ("mutation", "B", []), ("fragment", "F", [])]
    assert ops[0]["raw"].endswith("{ a { b } }")
    assert [x["id"] for x in mining.server_actions('createServerReference("' + "ab" * 20 + '") $ACTION $$ACTION_ID_' + "cd" * 20)] == ["ab" * 20, "cd" * 20]
    schemas = mining.validation_schemas("z.object({email: z.string().email(), age: z.number().min(1)}); yup.object({name: yup.string().required()})")
    assert [(s["library"], len(s["fields"])) for s in schemas] == [("zod", 2), ("yup", 1)]
    manifest = mining.build_manifest('self.__BUILD_MANIFEST={"/blog/[slug]":["static/chunks/a.js"],"/account":["b.js"],sortedPages:["/","/_app","/billing/invoices"]}')
    assert {"/blog/[slug]", "/account", "/billing/invoices"} <= set(manifest[0]["routes"])
    assert mining.chunk_map('a.u=function(e){return ""+e+"."+{102:"a1b2c3d4"}[e]+".js"}')[0]["chunks"] == ["102.a1b2c3d4.js"]
    assert mining.deobfuscate('"/a" + "pi" + "/x"; "\\x41"; atob("L3NlY3JldA==")') == '"/api/x"; "A"; "/secret"'
    assert mining.persisted_queries('{"doc_id":"1234567"} sha256Hash":"' + "a" * 64 + '"')[0] == {"client": "relay", "id": "1234567"}


def test_clouds_and_registry(spark):
    src = 'x={apiKey:"AIza' + "a" * 30 + '",projectId:"proj-1"}; dsn="https://' + "0" * 32 + '@o1.ingest.sentry.io/42"'
    out = {r.provider: r.config for r in mining.cloud_configs(frame(spark, [("u", src)], "url string, body string")).collect()}
    assert set(out) == {"firebase", "sentry"} and out["firebase"]["projectId"] == "proj-1"
    ops = mining.graphql_table(frame(spark, [("u", "query A($id: ID!) { a }")], "url string, body string"))
    assert mining.graphql_registry(ops).first()[0] == "# query A (id: ID!)\nquery A($id: ID!) { a }"


# --- search ---


def records(spark):
    names = ["gpt-6", "gpt6", "GPT-6", "gpt_6", "gpt-6x12", "gpt6-preview"] + [f"noise row {i}" for i in range(60)]
    rows = [(t, f"u{k % 7}", "chunk" if k % 2 else "script", k) for k, t in enumerate(names)]
    return search.add_units(frame(spark, rows, "text string, resource_url string, resource_kind string, ord int"))


def test_search_modes(spark):
    r = records(spark)
    texts = lambda q, mode, **kw: [x.text for x in search.search(r, q, mode, **kw).collect()]
    assert set(texts("gpt-6", "exact")) == {"gpt-6", "gpt-6x12"}
    assert texts("gpt-6", "substring")[0] == "gpt-6" and "GPT-6" in texts("gpt-6", "substring")
    assert len(texts("gpt-6", "normalized")) == 6
    assert set(texts("gpt[_-]6$", "regex")) == {"gpt-6", "gpt_6"}
    assert texts("gpt[", "regex") == [] == texts("", "fuzzy")
    assert set(texts("gpt-6", "fuzzy")[:6]) == {"gpt-6", "gpt6", "GPT-6", "gpt_6", "gpt-6x12", "gpt6-preview"}
    assert all("chunk" == x.resource_kind for x in search.search(r, "noise", "substring", scope=["chunk"]).collect())
    ids = {x.id for x in search.candidates(search.postings(r), search.trigram_postings(r), "gpt-6").collect()}
    assert {x.id for x in r.where("norm = 'gpt6'").collect()} <= ids


def test_typo_recall(spark):
    rows = [(f"noise-{i}-word", "u", "script", i) for i in range(300)] + [("gpt-6-astra-model", "u", "script", 999)]
    r = search.add_units(frame(spark, rows, "text string, resource_url string, resource_kind string, ord int"))
    assert search.search(r, "gpt-6-atsra", "fuzzy").first().text == "gpt-6-astra-model"


def test_surfaces(spark):
    s = {n: frame(spark, [(f"the carbon {n}", n)], "text string, resource_url string") for n in ("body", "url", "route", "store")}
    assert [r.surface for r in search.search_surfaces(s, "carbon").collect()] == ["body", "route", "url", "store"]
    assert [r.surface for r in search.search_surfaces(s, "in:state carbon").collect()] == ["store"]
    assert [r[0] for r in frame(spark, [("abcABab",)], "t string").select(search.matches_in_text(F.col("t"), "ab")).collect()] == [[0, 3, 5]]


# --- findings ---


def b64(value) -> str:
    return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")


@pytest.mark.parametrize(
    ("text", "rules"),
    [
        ("AKIA" + "IOSFODNN7QLMPLWX", ["aws_access_key"]),
        ("AKIA" + "XXXXXXXXXXXXXXXX", []),
        ("ASIA" + "IOSFODNN7QLMPLWX", ["aws_session_token"]),
        ("sk-" + "proj-" + "Zk9mQ2rT7uVw3xYb5nHd", ["openai_project"]),
        ('api_key = "a1b2c3d4"', []),
        ('api_key = "' + "0123456789abcdef01234567" + '"', []),
        ("0f3a9c1b2d4e5f60718293a4b5c6d7e8", []),
        ("short", []),
        ("pass" + 'word: "hunter22x"', ["password_assignment"]),
    ],
)
def test_secret_rules(spark, text, rules):
    found = secrets.scan(frame(spark, [(text,)], "text string")).collect()
    assert [f.rule for f in found] == rules


def test_jwt_without_algorithm(spark):
    token = f"{b64({'alg': 'none', 'typ': 'JWT'})}.{b64({'sub': 'abc', 'q': 1})}.c2lnbmF0dXJl"
    assert [f.rule for f in secrets.scan(frame(spark, [(f"x {token}",)], "text string")).collect()] == ["jwt", "jwt_none_alg"]


def test_all_secret_patterns_compile(spark):
    assert len(secrets.RULES) == 50
    for rule in secrets.RULES:
        assert search.valid_pattern(spark.range(1), rule[3]), rule[0]


def test_exposures(spark):
    res = frame(spark, [("https://x.y/a.js", True)], "url string, has_source_map boolean")
    routes = frame(spark, [("/admin",), ("/home",)], "route string")
    urls = frame(spark, [("https://x.y/p?access_token=1",), ("http://staging.x.y/",), ("http://staging.x.y/b",)], "url string")
    params = frame(spark, [("redirect",), ("page",)], "param string")
    out = exposures.merge(exposures.source_maps(res), exposures.sensitive_routes(routes), exposures.auth_in_url(urls), exposures.internal_hosts(urls), exposures.interesting_params(params)).collect()
    assert sorted(r.rule for r in out) == ["expo-auth-in-url", "expo-internal-domain", "expo-param", "expo-sensitive-endpoint", "expo-sourcemap"]
    assert out[0].sev == "high"


def test_hygiene_csp_frameworks(spark):
    rows = [("https://a.b/", "text/html", {"Set-Cookie": "sid=1", "Access-Control-Allow-Origin": "*", "Access-Control-Allow-Credentials": "true"}), ("https://c.d/", "text/html", {"Content-Security-Policy": "default-src 'self' vault.corp https://my-bucket.s3.amazonaws.com; connect-src localhost:3000 backend.internal"})]
    df = frame(spark, rows, "url string, mime string, headers map<string,string>")
    assert {"hyg-csp-missing", "hyg-cors-creds", "hyg-cookie-httponly", "hyg-cookie-secure"} <= {r.rule for r in exposures.hygiene(df).collect()}
    found = {(r.rule, r.text) for r in exposures.csp_findings(df).collect()}
    assert {("csp-internal-domain", "vault.corp"), ("csp-internal-domain", "backend.internal"), ("csp-internal-domain", "localhost"), ("csp-cloud-bucket", "my-bucket.s3.amazonaws.com")} <= found
    seen = frame(spark, [("https://a.b/_next/static/x.js", {}, {"Next-Action": "1"}), ("https://w.p/wp-content/a.css?ver=6.4", {}, {})], "url string, headers map<string,string>, req_headers map<string,string>")
    rules = {(r.rule, r.label) for r in exposures.frameworks(seen).collect()}
    assert ("fw-wordpress", "WordPress 6.4") in rules and {"fw-nextjs", "fw-cve-next-flight"} <= {r for r, _ in rules}


# --- APIs, graph, exports ---

EX = "seq long, url string, method string, status int, mime string, route string, req_headers map<string,string>, res_headers map<string,string>, req_body string, resp_body string"


def exchanges(spark):
    h = {"accept": "x"}
    return frame(spark, [(1, "https://a.b/api/users/123?x=1", "GET", 200, "application/json", "/r", h, h, None, '{"id": 1, "name": "n", "role": null}'), (2, "https://a.b/api/users/456", "GET", 404, "application/json", "/r", h, h, None, "{}"), (3, "https://a.b/api/users", "POST", 201, "application/json", "/q", h, h, '{"name": "n", "email": "e"}', '{"id": 2, "email": "e", "role": "x"}'), (4, "https://a.b/about", "GET", 200, "text/html", "/q", h, h, None, "<p>")], EX)


def test_inventory_and_evidence(spark):
    ex = exchanges(spark)
    routes = frame(spark, [("/api/users",), ("/api/orders",), ("/about",), ("/api/orders",)], "route string")
    assert [r.route for r in api.uncalled(routes, ex).collect()] == ["/api/orders"]
    kinds = {(r.method, r.url, r.detail) for r in api.inventory(ex, routes).collect()}
    assert ("?", "/api/orders", "uncalled") in kinds and ("POST", "https://a.b/api/users", "called ×1") in kinds
    ev = {r.template: r for r in api.evidence(ex, frame(spark, [("/api/orders", "app.js", 1)], "text string, resource_url string, ord int")).collect()}
    assert ev["/api/users/{id}"].calls == 2 and ev["/api/users/{id}"].last_status == 404 and ev["/api/orders"].badges == "S U"


def test_openapi_and_schemas(spark):
    doc = json.loads(api.openapi_document(exchanges(spark), frame(spark, [("/api/orders",)], "route string")).first()[0])
    assert set(doc["paths"]) == {"/api/users/{id}", "/api/users", "/about"}
    assert "requestBody" in doc["paths"]["/api/users"]["post"] and doc["x-uncalled"] == ["/api/orders"]
    assert doc["paths"]["/api/users/{id}"]["get"]["parameters"][0]["example"] == "123"
    assert api.infer_schema({"a": [1.5], "b": None, "c": True}) == {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "number"}}, "b": {"type": "string"}, "c": {"type": "boolean"}}}
    diff = api.key_diff(exchanges(spark).where("seq = 3"), "resp_body", "req_body").first()
    assert (diff.shared, diff.response_only, diff.request_only) == (["email"], ["id", "role"], ["name"])
    flags = frame(spark, [('{"a":false,"b":[false,1]}',), ("no",)], "s string").select(api.flags_on(F.col("s"))).collect()
    assert [r[0] for r in flags] == ['{"a":true,"b":[true,1]}', "no"]


def test_har_round_trip(spark, tmp_path):
    ex = exchanges(spark)
    doc = har.document(ex).first()[0]
    assert json.loads(doc)["log"]["version"] == "1.2"
    (tmp_path / "a.har").write_text(doc)
    (tmp_path / "b.har").write_text("{}")
    back = {r.url: r for r in har.read(spark, str(tmp_path)).collect()}
    assert len(back) == 4 and back["https://a.b/api/users"].method == "POST" and back["https://a.b/api/users"].req_body.startswith('{"name"')
    har.write(ex, str(tmp_path / "lines"))
    assert har.read_lines(spark, str(tmp_path / "lines")).count() == 4
    entry = json.dumps({"request": {"method": "get", "url": "https://x.y/"}, "response": {"status": 200, "content": {"text": "aGk=", "encoding": "base64"}}})
    assert har.parse_entries(frame(spark, [(entry,)], "entry string")).first().resp_body == "hi"
    assert [r[0] for r in frame(spark, [(doc,), ("{}",)], "t string").select(har.is_valid(F.col("t"))).collect()] == [True, False]


def test_exports(spark, tmp_path):
    ex = exchanges(spark)
    line = ex.where("seq = 1").select(exports.curl(F.col("method"), F.col("url"), F.col("req_headers"))).first()[0]
    assert line == "curl -X GET 'https://a.b/api/users/123?x=1' -H 'accept: x'"
    kept = frame(spark, [({"Authorization": "a", "Host": "h", "sec-ch": "1", ":path": "p", "ok": "1", "bad name": "x"},)], "h map<string,string>").select(exports.sanitize_headers(F.col("h"))).first()[0]
    assert set(kept) == {"Authorization", "ok"}
    exports.save_session({"exchanges": ex}, str(tmp_path / "s"))
    assert exports.open_session(spark, str(tmp_path / "s"))["exchanges"].count() == 4
    import io
    import zipfile

    data = exports.source_zip([("webpack:///../src/a.ts", "x"), ("src/a.ts", "y")])
    assert zipfile.ZipFile(io.BytesIO(data)).namelist() == ["src/a.ts", "src/a.ts.1"] and data[:4] == b"PK\x03\x04"
    assert len(exports.source_zip([])) == 22
    sections = {r.section for r in exports.dossier(ex, frame(spark, [("/api/orders",), ("/contact",)], "route string")).collect()}
    assert sections == {"called", "uncalled", "page"}


def test_graph(spark):
    pages = frame(spark, [("https://a.b/", '<a href="/x">1</a><a href="https://c.d/">2</a>'), ("https://a.b/x", '<a href="y#f">3</a>')], "url string, html string")
    edges = graph.page_edges(pages)
    assert {(r.src, r.dst) for r in edges.collect()} == {("https://a.b/", "https://a.b/x"), ("https://a.b/", "https://c.d/"), ("https://a.b/x", "https://a.b/y")}
    seeds = frame(spark, [("https://a.b/",)], "url string")
    assert {(r.url, r.depth) for r in graph.crawl(edges, seeds).collect()} == {("https://a.b/", 0), ("https://a.b/x", 1), ("https://a.b/y", 2)}
    assert frame(spark, [("https://a.b/c/d", "../e")], "b string, r string").select(url_resolve("b", "r")).first()[0] == "https://a.b/e"


def test_contained_items(spark):
    items = ["7 up", "x", "é", "", "lower case item of more than thirty-two octets", "数学题目是什么", '"Quoted', "Capital item with many letters", "7 up", None]
    texts = ["a7 up", "", None, "prefixlower case item of more than thirty-two octets", "这个数学题目是什么呢", 'he said "Quoted', "wordCapital item with many lettersé", "7 u", "a7 up"]
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    wanted = frame(spark, list(enumerate(items)), "item_id long, text string")
    want = sorted((i, k) for i, t in enumerate(texts) for k, x in enumerate(items) if t is not None and x is not None and x in t)
    for chars in (4_000_000, 20):
        assert sorted(map(tuple, search.contained(docs, wanted, chars).collect())) == want
    assert search.contained(docs.limit(0), wanted).count() == search.contained(docs, wanted.limit(0)).count() == 0


def test_as_of_takes_the_newest_entry_left(spark):
    import random

    from quarrylens.operators import tables

    rnd = random.Random(5)
    rows = [(k, rnd.choice("aab"), rnd.randrange(400), rnd.random() < 0.5) for k in range(300)]
    start = 1_700_000_000
    at = lambda s: F.timestamp_seconds(F.lit(start) + s)
    df = frame(spark, [(k, u, s, e) for k, u, s, e in rows] + [(900, None, 1, True), (901, None, 0, False)], "id int, user string, s int, is_event boolean").withColumn("ts", at(F.col("s")))
    events = df.where("is_event").select(F.col("id").alias("event_id"), "user", "ts")
    entries = df.where("not is_event").select(F.col("id").alias("entry_id"), "user", "ts")
    for seconds in (1, 7, 30):
        want, open_entries = set(), {"a": [], "b": []}
        for k, u, s, is_event in sorted(rows, key=lambda r: (r[2], r[3], r[0])):
            if not is_event:
                open_entries[u].append((s, k))
            elif open_entries[u] and s - open_entries[u][-1][0] <= seconds:
                then, entry = open_entries[u].pop()
                want.add((u, k, entry, (s - then) * 1_000_000))
        assert {tuple(r) for r in tables.as_of(events, entries, ["user"], seconds).collect()} == want
    assert tables.as_of(events.limit(0), entries, ["user"]).count() == 0


def test_places_of_matches_in_every_mode(spark):
    import re

    texts = ["", "The the THE", "athe.the*the", "x\U0001f600the", "the﷐the", "a1 22 333", "thethe" * 300]
    df = frame(spark, [(t,) for t in texts] + [(None,)], "t string")
    for mode, query, pattern, flags in (("exact", "the", "the", 0), ("substring", "tHe", "the", re.I), ("regex", "t.e|[0-9]+", "t.e|[0-9]+", re.I), ("regex", "x*", "x+", re.I), ("exact", ".", r"\.", 0)):
        got = [[(m.at, m.len, m.score) for m in r.matches] if r.matches is not None else None for r in search.with_matches(df, query, mode, "t").collect()]
        score = {"exact": 1.0, "regex": 0.95}.get(mode)
        assert got == [[(m.start(), m.end() - m.start(), score or (1.0 if m[0] == query else 0.92)) for m in re.finditer(pattern, t, flags)] for t in texts] + [None]
    assert [r.matches for r in search.with_matches(df, "(", "regex", "t").collect()][:2] == [[], []]
    assert [len(r.matches) for r in search.with_matches(df.dropna(), "the", text="t", most=2).collect()] == [0, 2, 2, 1, 2, 0, 2]


def test_marks_are_places_in_the_text(spark):
    from quarrylens.functions.text import normalize

    texts = ["use gpt-6-astra-model now", "GPT_6: model", "no such thing", "gpt.6-atsra"]
    records = frame(spark, [(t, "u", "script", k) for k, t in enumerate(texts)], "text string, resource_url string, resource_kind string, ord int").withColumn("norm", normalize(F.col("text")))
    found = {r.ord: r for r in search.search(records, "gpt-6", "normalized").collect()}
    assert {k: texts[k][r.start : r.start + r.length] for k, r in found.items()} == {0: "gpt-6", 1: "GPT_6", 3: "gpt.6"}
    fuzzy = {r.ord: r for r in search.search(records, "gpt-6-atsra", "fuzzy").collect()}
    assert [fuzzy[0].context[m.s : m.e] for m in fuzzy[0].marks][0].startswith("gpt-6-as") and fuzzy[3].context[fuzzy[3].marks[0].s : fuzzy[3].marks[0].e] == texts[3]


def test_rpc_input_keys_come_with_a_procedure():
    src = 'fetch("/trpc/user.list?batch=1"); const q = {input: {"limit": 5, "cursor": null}};'
    found = {(k, t, e) for k, t, _, e in extract.js_unit_list(src) if k == "trpc-proc"}
    assert {("trpc-proc", "limit", "trpc:input"), ("trpc-proc", "cursor", "trpc:input")} <= found
    assert not [u for u in extract.js_unit_list('const q = {input: {"limit": 5}};') if u[0] == "trpc-proc"]


def test_windows_of_a_script_give_the_units_of_the_whole(spark):
    src = "\n".join(f'fetch("/api/v{k}/items"); // {"x" * 20}' for k in range(400))
    scripts = frame(spark, [("s", src), ("t", ""), ("n", None)], "url string, body string")
    units = lambda df: {(r.resource_url, r.kind, r.text, r.line) for r in df.collect() if r.kind in ("endpoint", "fetch-target")}
    assert units(extract.windowed_js_units(scripts, 1_000, 100)) == units(extract.js_units(scripts))
    assert extract.script_windows(scripts, 1_000, 100).where("url <> 's'").count() == 2


def test_url_finder_tolerates_typos(spark):
    from quarrylens.functions.fuzzy import match
    from quarrylens.operators import views

    rows = ["https://a.example/api/users", "https://a.example/usres", "/u", "", None, "https://a.example/static/style.css", "USERS"]
    got = {r[0] for r in frame(spark, [(u,) for u in rows], "url string").where(views.found(F.col("url"), " Users ")).collect()}
    assert got == {u for u in rows if "users" in (u or "").lower() or match("users", search.norm_of(u or ""))[0] >= 0.45}
    assert "https://a.example/usres" in got and None not in got
    assert frame(spark, [(u,) for u in rows], "url string").where(views.found(F.col("url"), " ")).count() == len(rows)


def test_text_lines_trim_white_space(spark):
    body = " \t a  b\x0b\x0c\r\n\n   \nab \n\u00a0abc\u00a0\r\nabc"
    found = extract.text_lines(frame(spark, [("u", body), ("n", None)], "url string, body string")).collect()
    assert [(r.resource_url, r.ord, r.line, r.kind, r.text) for r in found] == [("u", 0, 1, "text-line", "a  b"), ("u", 4, 5, "text-line", "\u00a0abc\u00a0"), ("u", 5, 6, "text-line", "abc")]
