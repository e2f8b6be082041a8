import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quarrylens import sqlreg
from quarrylens.functions import decode, fuzzy, pretty, text, urls
from quarrylens.functions.redact import redact, redact_headers
from quarrylens.operators.extract import path_class


def values(spark, rows, fn, schema="s string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).coalesce(1)
    return [r[0] for r in df.select(fn).collect()]


def test_normalize(spark):
    forms = ["gpt-6", "gpt6", "GPT-6", "gpt_6", "gpt.6", "GPT6"]
    assert set(values(spark, forms, text.normalize(F.col("s")))) == {"gpt6"}
    once = values(spark, ["A-b É~c*"], text.normalize(text.normalize(F.col("s"))))
    assert once == values(spark, ["A-b É~c*"], text.normalize(F.col("s"))) == ["abÉc"]


def test_trigrams_and_tokens(spark):
    assert values(spark, ["abcd", "ab", ""], text.trigrams(F.col("s"))) == [["abc", "bcd"], ["ab"], []]
    assert values(spark, ["abc,d,é1(x)"], text.tokenize(F.col("s"))) == [["abc", "é1"]]


def test_entropy_lines_snippet(spark):
    assert values(spark, ["aabbccdd", "", "aaaa"], text.shannon(F.col("s"))) == [2.0, 0.0, 0.0]
    assert values(spark, ["a\nbc\nd"], text.line_of(F.col("s"), F.lit(3))) == [2]
    assert values(spark, ["a\nbc\nd"], text.column_of(F.col("s"), F.lit(3))) == [2]
    assert values(spark, ["x" * 100 + "HIT" + "y" * 100], text.snippet(F.col("s"), F.lit(100), F.lit(3), 5)) == ["…xxxxxHITyyyyy…"]
    assert values(spark, ["a\nb"], text.add_line_numbers(F.col("s"))) == ["  1 | a\n  2 | b"]
    assert values(spark, ["A: b\nno\nA: c\nD: e:f"], text.parse_header_lines(F.col("s"))) == [{"A": "b", "D": "e:f"}]


@pytest.mark.parametrize(
    ("n", "h", "score"),
    [("gpt6", "gpt6", 1), ("gpt6", "gpt6x12", 0.9886), ("gpt6", "gpt6preview", 0.9878), ("gpt6", "zzzunrelatedqqq", 0), ("models", "modles", 0.77), ("gpt6atsra", "gpt6astramodel", 0.77), ("models", "listmodlsapi", 0.71), ("user", "users", 0.989), ("abc", "alongbtextc", 0.84), ("modelsx", "models", 0)],
)
def test_fuzzy_scores(n, h, score):
    value, spans = fuzzy.match(n, h)
    assert value == pytest.approx(score, abs=6e-4)
    assert all(0 <= a < b <= len(h) for a, b in spans)


def test_edit_distance_counts_transpositions():
    assert fuzzy.edit_distance("models", "modles", 2) == 1
    assert fuzzy.edit_distance("abc", "xyz", 2) == 3


PATHS = [("/api/models", "endpoint"), ("/v1/chat", "endpoint"), ("/graphql", "endpoint"), ("/dashboard/settings", "route"), ("/1999/xhtml", None), ("/2000/svg", None), ("/1998/Math/MathML", None), ("/a/b.css", "asset"), ("api/x", "endpoint"), ("//cdn.x/y", None), ("/123", None), ("x y", None)]


def test_fuzzy_windows_of_a_batch(monkeypatch):
    """Ends that the bit vectors find are those of all parts compared one by one; scores stay, and far texts cost no comparison."""
    r = random.Random(3)
    for n in ("abc", "abcab", "apache", "apachelisence", "ab" * 32, "aé😀b", "ab", "a" * 65):
        texts = ["", n, n[:-1], n[1:] + "c", "x" * 330 + n]
        for _ in range(20):
            h = [r.choice(n + "x") for _ in range(r.randint(1, 40))]
            at = r.randrange(len(h))
            texts.append("".join(h[:at]) + n[: len(n) // 2] + r.choice(["", "x", n[0]]) + n[len(n) // 2 + 1 :] + "".join(h[at:]))
        most = 1 if len(n) <= 5 else 2
        found = fuzzy.near_ends(n, texts)
        for h, ends in zip(texts, found):
            t = h[:320]
            near = {e for e in range(1, len(t) + 1) if any(fuzzy.edit_distance(n, t[s:e], most) <= most for s in range(max(0, e - len(n) - most), e + 1))}
            assert ends == (near if 3 <= len(n) <= 64 else set())
            assert fuzzy.match(n, h, ends) == fuzzy.match(n, h)
    far = "a dull line that is quite far from what is sought, and again a dull line"
    ends = fuzzy.near_ends("apachelisence", [far])[0]
    monkeypatch.setattr(fuzzy, "edit_distance", None)
    assert fuzzy.match("apachelisence", far, ends) == (0.0, [])


def test_path_classes(spark):
    got = values(spark, [p for p, _ in PATHS], urls.classify_path(F.col("s")))
    assert got == [c for _, c in PATHS] == [path_class(p) for p, _ in PATHS]


def test_hosts_and_templates(spark):
    rows = ["https://API.X.example:8080/a?b=1#c", "/rel?x=1", None, "https://u:p@h.test"]
    assert values(spark, rows, urls.host_of(F.col("s"))) == ["api.x.example", "", "", "h.test"]
    assert values(spark, rows, urls.path_of(F.col("s"))) == ["/a", "/rel", "", "/"]
    assert values(spark, ["/users/123/posts", "/v10/x", "/"], urls.template_openapi(F.col("s"))) == ["/users/{id}/posts", "/v10/x", "/"]
    assert values(spark, ["/users/123/v10?q"], urls.template_path(F.col("s"))) == ["/users/{id}/{id}"]
    assert values(spark, ["/a/1/2/3/b", "/x/" + "a" * 32, "/u/01234567-89ab-cdef-0123-456789abcdef"], urls.normalize_dynamic(F.col("s"))) == ["/a/{id}/2/{id}/b", "/x/{hash}", "/u/{uuid}"]
    assert urls.resolve_url("https://H.test/a/b", "../für x") == "https://h.test/f%C3%BCr%20x"
    assert urls.resolve_url(None, "/x") is None


def test_mime_groups_and_kinds(spark):
    rows = [("application/json", "x"), ("text/javascript", ""), ("text/css", ""), ("text/html", ""), ("image/png", ""), ("", "a.js?x=1"), ("", "q"), ("model/gltf", "q")]
    assert values(spark, rows, urls.mime_group(F.col("m"), F.col("u")), "m string, u string") == ["json", "js", "css", "html", "img", "js", "unknown", "model"]
    rows = [("wss://x", "", ""), ("/x", "application/grpc-web", ""), ("/x", "text/event-stream", ""), ("/graphql", "", ""), ("/trpc/a", "", ""), ("/x", "", '{"method": 1}'), ("/x", "text/soap", ""), ("/api/x", "", ""), ("/x", "", "")]
    assert values(spark, rows, urls.api_kind(F.col("u"), F.col("m"), F.col("b")), "u string, m string, b string") == ["WebSocket", "gRPC-Web", "SSE", "GraphQL", "tRPC", "JSON-RPC", "SOAP", "REST", "Other"]


def test_redaction(spark):
    jwt = "eyJ" + "abcd1234" + ".eyJ" + "abcd1234" + ".sig"
    out = values(spark, [f"mail me@x.org sessionid={'a' * 12} {jwt} password: hunter22", None], redact(F.col("s")))
    assert out == ['mail [USER_EMAIL_REDACTED] sessionid=[REDACTED_SESSION] [REDACTED_JWT] password: "[REDACTED_SECRET]"', ""]
    df = spark.createDataFrame([({"Cookie": "a", "Authorization": "Bearer x", "X": "me@x.org"},)], "h map<string,string>")
    assert df.select(redact_headers(F.col("h"))).first()[0] == {"Cookie": "[REDACTED_COOKIES]", "Authorization": "Bearer [REDACTED_AUTH_TOKEN]", "X": "[USER_EMAIL_REDACTED]"}


def test_decoders():
    assert decode.protobuf(b"\x0a\x05admin\x10\x2a") == {"field_1": "admin", "field_2": 42}
    inner = b"\x0a\x03abc"
    assert decode.protobuf(b"\x00" + struct.pack(">L", 4) + b"\x08\x01\x10\x02") == {"field_1": 1, "field_2": 2}
    assert decode.protobuf(b"\x12" + bytes([len(inner) + 2]) + inner + b"\x10\x80")["field_2"] is not None
    assert decode.msgpack(b"\x83\xa2id\x01\xa4role\xa5admin\xa6active\xc3") == {"id": 1, "role": "admin", "active": True}
    assert decode.flight('1:"$x"\n2:I["a"]\n3:{"token":"x"}\n')["sensitive"] == ["token"]
    stream = 'data: {"choices":[{"delta":{"content":"Hello "}}]}\ndata: {"choices":[{"delta":{"content":"world! ","tool_calls":[{"index":0,"function":{"name":"queryDatabase","arguments":"{}"}}]}}]}\ndata: [DONE]'
    assert decode.model_stream(stream) == {"text": "Hello world! ", "tools": [{"name": "queryDatabase", "arguments": "{}"}], "system": []}
    module = b"\0asm\1\0\0\0" + b"\x07\x0c\x01\x08authFunc\x00\x00" + b"\x0b\x10https://x.y/api/"
    assert decode.wasm_module(module)["exports"] == ["func authFunc"]
    assert decode.ws_frame('42["chat",{"a":1}]')["event"] == "chat"
    assert decode.ws_frame('{"type":"subscribe","payload":{}}')["kind"] == "graphql-ws"
    assert decode.decompressed(zlib.compress(b"abc")) == b"abc"
    assert decode.hex_dump_text(b"AB").startswith("00000000  41 42 ")
    assert decode.source_map_files(json.dumps({"sources": ["src/a.ts", "b", "c"], "sourcesContent": ["x" * 11, None, "short"]})) == [{"path": "src/a.ts", "content": "x" * 11}]


def test_categories(spark):
    rows = [("", "", b"\x1f\x8b\x08"), ("", "", b"PK\x03\x04"), ("", "", b"\x89PNG"), ("", "", b"\0asm"), ("x.js", "", b"a"), ("", "application/json", b"x"), ("", "", b"<svg/>"), ("", "", b'{"a":1}'), ("", "", b"plain"), ("", "", b"<!doctype html>")]
    assert values(spark, rows, decode.content_category(F.col("u"), F.col("m"), F.col("b")), "u string, m string, b binary") == ["gzip", "zip", "image", "wasm", "javascript", "json", "svg", "json", "text", "html"]


def test_pretty():
    assert pretty.pretty_json('{"a":[1]}') == '{\n  "a": [\n    1\n  ]\n}'
    assert pretty.pretty_blocks("function f(){for(i=0;i<3;i++){a('x;y')}return 1;}") == "function f(){\n  for(i=0;i<3;i++){\n    a('x;y')\n  }\n  return 1;\n}"
    assert pretty.pretty_html("<div><p>x</p><br></div>") == "<div>\n  <p>\n    x\n  </p>\n  <br>\n</div>"


def test_sql_functions(spark):
    sqlreg.register(spark)
    row = spark.sql("SELECT norm_text('A-b'), url_host('https://X.y/z'), url_query('/a?b=1#c'), severity_rank('high'), url_resolve('https://a.b/c', 'd')").first()
    assert list(row) == ["ab", "x.y", "b=1", 1, "https://a.b/d"]
