"""Wire decoders: sniffing, ZIP listings, protobuf, MessagePack, flight streams, socket frames, model streams, WASM."""

from __future__ import annotations

import json
import re
import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Content category by leading bytes, in hexadecimal, in order.
MAGIC = (("1F8B", "gzip"), ("504B0304", "zip"), ("504B0506", "zip"), ("89504E47", "image"), ("FFD8FF", "image"), ("47494638", "image"), ("0061736D", "wasm"))
# Content category by type or name, in order.
BY_NAME = (
    (r"wasm", "wasm"),
    (r"text/x-component", "rsc"),
    (r"event-stream", "ai-stream"),
    (r"svg", "svg"),
    (r"image/|\.(png|jpe?g|gif|webp|avif|ico)(\z|\?)", "image"),
    (r"audio/|\.(mp3|wav|ogg)(\z|\?)", "audio"),
    (r"video/|\.(mp4|webm)(\z|\?)", "video"),
    (r"protobuf|grpc|\.(pb|proto)(\z|\?)", "protobuf"),
    (r"msgpack", "msgpack"),
    (r"json|\.(json|map)(\z|\?)", "json"),
    (r"javascript|ecmascript|\.m?jsx?(\z|\?)", "javascript"),
    (r"css", "css"),
    (r"html", "html"),
    (r"xml", "xml"),
)


def content_category(url: Column, mime: Column, body: Column) -> Column:
    """Category of a body (binary) by its first bytes, then type and name, then its text."""
    head, name = F.hex(F.substring(body, 1, 4)), F.lower(F.concat_ws(" ", mime, url))
    text = F.try_to_binary(F.substring(body, 1, 512).cast("string"), F.lit("utf-8")).cast("string")
    out = F.lit(None).cast("string")
    for magic, kind in reversed(MAGIC):
        out = F.when(head.startswith(magic), kind).otherwise(out)
    by_name = F.coalesce(*[F.when(name.rlike(p), F.lit(k)) for p, k in BY_NAME])
    by_text = (
        F.when(text.rlike(r"\A\s*<svg"), "svg")
        .when(text.rlike(r"(?i)\A\s*(<!doctype html|<html)"), "html")
        .when(text.rlike(r"\A\s*<\?xml"), "xml")
        .when(text.rlike(r"(?m)\A[0-9a-f]+:[IHTMS]?[\[\"{]"), "rsc")
        .when(text.rlike(r"\A\s*[\[{]"), "json")
        .when(F.length(F.regexp_replace(text, r"[\x00-\x08\x0E-\x1F\x{FFFD}]", "")) < 0.85 * F.length(text), "binary")
    )
    return F.coalesce(out, by_name, by_text, F.lit("text"))


def hex_dump_text(data: bytes, most: int | None = 32_768) -> str:
    data = data if most is None else data[:most]
    rows = []
    for at in range(0, len(data), 16):
        part = data[at : at + 16]
        codes = " ".join(f"{b:02x}" for b in part)
        rows.append(f"{at:08x}  {codes:<47}  |{''.join(chr(b) if 32 <= b < 127 else '.' for b in part)}|")
    return "\n".join(rows)


def decompressed(data: bytes) -> bytes:
    """gzip or zlib data opened, other data as it is."""
    for wbits in (31, 15) if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" else ():
        try:
            return zlib.decompress(data, wbits)
        except zlib.error:
            continue
    return data


def zip_listing(data: bytes, most: int = 500) -> list[dict]:
    """Names and sizes from the local headers of a ZIP file."""
    out, at = [], data.find(b"PK\x03\x04")
    while 0 <= at <= len(data) - 30 and len(out) < most:
        packed, size, n_name, n_extra = struct.unpack("<2L2H", data[at + 18 : at + 30])
        out.append({"name": data[at + 30 : at + 30 + n_name].decode("utf-8", "replace"), "packed": packed, "size": size})
        at = data.find(b"PK\x03\x04", at + 30 + n_name + n_extra + packed)
    return out


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at
        if shift > 63:
            raise ValueError("varint is too long")


def protobuf(data: bytes, depth: int = 0) -> dict:
    """Fields ``field_N`` of a message without its schema; a gRPC-web frame's header is taken off. ValueError if it isn't one."""
    if depth == 0 and len(data) > 5 and data[0] in (0, 1) and struct.unpack(">L", data[1:5])[0] == len(data) - 5:
        data = data[5:]
    out: dict[str, object] = {}
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        wire, name = tag & 7, f"field_{tag >> 3}"
        if not tag >> 3:
            raise ValueError("field 0")
        if wire == 0:
            value, at = varint(data, at)
            value = str(value) if value > 1 << 53 else value
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            if at + size > len(data):
                raise ValueError("cut off")
            value = struct.unpack("<d" if wire == 1 else "<f", data[at : at + size])[0]
            at += size
        elif wire == 2:
            size, at = varint(data, at)
            if at + size > len(data):
                raise ValueError("cut off")
            value, at = _payload(data[at : at + size], depth), at + size
        else:
            raise ValueError(f"wire type {wire}")
        if name in out:
            out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), value]
        else:
            out[name] = value
    return out


def _payload(part: bytes, depth: int) -> object:
    try:
        text = part.decode("utf-8")
        if all(c.isprintable() or c in "\n\r\t" for c in text):
            return text
    except UnicodeDecodeError:
        pass
    if depth < 6 and part:
        try:
            return protobuf(part, depth + 1)
        except (ValueError, IndexError):
            pass
    return part[:32].hex()


def msgpack(data: bytes) -> object:
    """One MessagePack value; extension types are None. ValueError for data that ends early."""

    def take(at: int, size: int) -> bytes:
        if at + size > len(data):
            raise ValueError("cut off")
        return data[at : at + size]

    def read(at: int) -> tuple[object, int]:
        b = take(at, 1)[0]
        at += 1
        if b < 0x80:
            return b, at
        if b >= 0xE0:
            return b - 256, at
        if b < 0x90:
            return table(at, b & 15)
        if b < 0xA0:
            return listed(at, b & 15)
        if b < 0xC0:
            return take(at, b & 31).decode("utf-8", "replace"), at + (b & 31)
        if b in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[b], at
        number = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">L", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">l", 0xD3: ">q"}.get(b)
        if number:
            size = struct.calcsize(number)
            return struct.unpack(number, take(at, size))[0], at + size
        wide = {0xC4: 1, 0xC5: 2, 0xC6: 4, 0xD9: 1, 0xDA: 2, 0xDB: 4, 0xDC: 2, 0xDD: 4, 0xDE: 2, 0xDF: 4, 0xC7: 1, 0xC8: 2, 0xC9: 4}.get(b)
        if wide:
            n, at = int.from_bytes(take(at, wide), "big"), at + wide
            if b in (0xD9, 0xDA, 0xDB):
                return take(at, n).decode("utf-8", "replace"), at + n
            if b in (0xC4, 0xC5, 0xC6):
                return take(at, n).hex(), at + n
            if b in (0xDC, 0xDD):
                return listed(at, n)
            return table(at, n) if b in (0xDE, 0xDF) else (None, at + 1 + n)
        return None, at + 1 + {0xD4: 1, 0xD5: 2, 0xD6: 4, 0xD7: 8, 0xD8: 16}.get(b, 0)

    def listed(at: int, n: int) -> tuple[list, int]:
        out = []
        for _ in range(n):
            value, at = read(at)
            out.append(value)
        return out, at

    def table(at: int, n: int) -> tuple[dict, int]:
        out = {}
        for _ in range(n):
            key, at = read(at)
            out[str(key)], at = read(at)
        return out, at

    return read(0)[0]


SENSITIVE = re.compile(r"\"([^\"]*(?:password|secret|token|api_?key|session)[^\"]*)\"\s*:", re.I)


def flight(text: str) -> dict:
    """Rows ``id:tag payload`` of a flight stream (also as pushed chunks), its action ids and sensitive keys."""
    pushed = re.findall(r"__next_f\.push\(\s*\[\s*\d+\s*,\s*(\"(?:[^\"\\]|\\.)*\")\s*\]\s*\)", text)
    body = "".join(json.loads(p) for p in pushed) if pushed else text
    rows = [{"id": m[1], "tag": m[2] or "", "payload": m[3]} for m in re.finditer(r"(?m)^([0-9a-f]+):([A-Z]{1,2})?(.*)$", body)]
    return {"entries": rows, "actions": sorted(set(re.findall(r"\b[0-9a-f]{40,42}\b", body))), "sensitive": list(dict.fromkeys(SENSITIVE.findall(body)))}


def ws_frame(text: str) -> dict:
    """Kind and event of a socket frame: Socket.IO, GraphQL over sockets, JSON, raw."""
    m = re.match(r"4\d(?:/[^,]*,)?\d*(\[.*)\Z", text, re.S)
    if m:
        try:
            event, *rest = json.loads(m[1])
            return {"kind": "socket.io", "event": str(event), "payload": json.dumps(rest)}
        except (ValueError, TypeError):
            pass
    try:
        value = json.loads(text)
    except ValueError:
        return {"kind": "raw", "event": None, "payload": text}
    kinds = ("connection_init", "connection_ack", "subscribe", "next", "start", "data", "complete", "error", "ping", "pong", "ka", "stop")
    if isinstance(value, dict) and value.get("type") in kinds:
        return {"kind": "graphql-ws", "event": value["type"], "payload": json.dumps(value.get("payload"))}
    return {"kind": "json", "event": value.get("type") if isinstance(value, dict) and isinstance(value.get("type"), str) else None, "payload": text}


def model_stream(text: str) -> dict:
    """Text, tool calls and system prompts put together from the ``data:`` lines of a language model's answer."""
    said, tools, systems = [], {}, {}
    order: list[object] = []
    for line in text.splitlines():
        line = line.strip().removeprefix("data:").strip()
        try:
            value = json.loads(line) if line[:1] == "{" else None
        except ValueError:
            value = None
        if not isinstance(value, dict):
            continue
        for choice in value.get("choices") or []:
            delta = choice.get("delta") or choice.get("message") or {}
            said.append(delta.get("content") or "")
            for call in delta.get("tool_calls") or []:
                key = call.get("index", call.get("id"))
                own = tools.setdefault(key, {"name": "", "arguments": ""})
                function = call.get("function") or {}
                own["name"] = own["name"] or function.get("name") or ""
                own["arguments"] += function.get("arguments") or ""
        block, delta = value.get("content_block") or {}, value.get("delta") or {}
        if block.get("type") == "tool_use":
            tools[value.get("index")] = {"name": block.get("name") or "", "arguments": ""}
        if isinstance(delta, dict):
            said.append(delta.get("text") or "")
            if "partial_json" in delta and value.get("index") in tools:
                tools[value.get("index")]["arguments"] += delta["partial_json"]
        if isinstance(value.get("response"), str):
            said.append(value["response"])
        for message in value.get("messages") or []:
            if message.get("role") == "system":
                systems[str(message.get("content"))] = None
    order.extend(tools.values())
    return {"text": "".join(said), "tools": order, "system": list(systems)}


def wasm_module(data: bytes) -> dict:
    """Imports, exports, printable strings and endpoints of a module; empty lists where it isn't one or is cut off."""
    out = {"imports": [], "exports": [], "strings": [], "endpoints": []}
    if data[:4] != b"\0asm":
        return out
    kinds = ("func", "table", "memory", "global", "tag")

    def name(at: int) -> tuple[str, int]:
        n, at = varint(data, at)
        return data[at : at + n].decode("utf-8", "replace"), at + n

    def limits(at: int) -> int:
        flags, at = varint(data, at)
        _, at = varint(data, at)
        return varint(data, at)[1] if flags & 1 else at

    at = 8
    try:
        while at < len(data):
            section, size = data[at], 0
            size, start = varint(data, at + 1)
            p = start
            if section == 2:
                n, p = varint(data, p)
                for _ in range(n):
                    module, p = name(p)
                    field, p = name(p)
                    kind = data[p]
                    p += 1
                    p = varint(data, p)[1] if kind == 0 else limits(p + 1) if kind == 1 else limits(p) if kind == 2 else p + 2
                    out["imports"].append(f"{module}.{field}")
            elif section == 7:
                n, p = varint(data, p)
                for _ in range(n):
                    field, p = name(p)
                    kind, (_, p) = data[p], varint(data, p + 1)
                    out["exports"].append(f"{kinds[kind] if kind < len(kinds) else kind} {field}")
            at = start + size
    except IndexError:
        pass
    out["strings"] = list(dict.fromkeys(m.decode("ascii") for m in re.findall(rb"[\x20-\x7e]{5,300}", data)))
    out["endpoints"] = list(dict.fromkeys(e for s in out["strings"] for e in re.findall(r"https?://[^\s\"'`<>]{4,200}|/(?:api|v\d+|graphql|trpc|rest)/[\w./{}:-]{1,200}", s)))
    return out


def source_map_files(text: str) -> list[dict]:
    """(path, content) of a source map that carries its sources."""
    try:
        value = json.loads(text.removeprefix(")]}'"))
        pairs = zip(value["sources"], value["sourcesContent"], strict=False)
    except (ValueError, KeyError, TypeError):
        return []
    return [{"path": str(p), "content": c} for p, c in pairs if isinstance(c, str) and len(c) > 10]


def _as_json(run, binary: bool):
    @F.pandas_udf(T.StringType())
    def decode(body: pd.Series) -> pd.Series:
        def one(x):
            if x is None or isinstance(x, float):
                return None
            try:
                return json.dumps(run(bytes(x) if binary else x), ensure_ascii=False)
            except (ValueError, IndexError, KeyError, TypeError, AttributeError, RecursionError):
                return None

        return body.map(one)

    return decode


#: Columns of JSON text: null for null bodies and for those that aren't of the form.
protobuf_json = _as_json(protobuf, True)
msgpack_json = _as_json(msgpack, True)
zip_json = _as_json(zip_listing, True)
wasm_json = _as_json(wasm_module, True)
flight_json = _as_json(flight, False)
frame_json = _as_json(ws_frame, False)
model_stream_json = _as_json(model_stream, False)
source_map_json = _as_json(source_map_files, False)


@F.pandas_udf(T.StringType())
def hex_dump(body: pd.Series) -> pd.Series:
    return body.map(lambda b: None if b is None else hex_dump_text(bytes(b)))


@F.pandas_udf(T.BinaryType())
def decompress(body: pd.Series) -> pd.Series:
    return body.map(lambda b: None if b is None else decompressed(bytes(b)))


def map_candidates(url: str) -> list[str]:
    """Where a script's source map may lie."""
    bare = url.split("?")[0].split("#")[0]
    tail = bare.rsplit("/", 1)
    return list(dict.fromkeys([f"{bare}.map", re.sub(r"\.m?js$", ".map", bare), f"{tail[0]}/maps/{tail[-1]}.map" if len(tail) == 2 else f"{bare}.map"]))
