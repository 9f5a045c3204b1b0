import base64
import gzip
import random
import re
import zlib
from urllib.parse import quote

from coinsight.llm import secrets


def brute(text):
    """The three rules straight from their statement."""
    out = []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_open_secrets_match_brute_force():
    rnd = random.Random(3)
    parts = ["token", "SECRET", "=", ":", '"', " ", "abcdefgh", "AKIA", "ABCD1234EFGH", "0123456789abcdef" * 2, "é", "api_key", "\n", "ſecret", "x=y"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert secrets.scan(text) == brute(text), text


def test_nested_layers_map_to_the_original():
    inner = "password=hunter2hunter2"
    for wrapped in (base64.b64encode(inner.encode()).decode(), base64.b64encode(gzip.compress(inner.encode())).decode(), base64.b64encode(base64.b64encode(zlib.compress(inner.encode()))).decode()):
        text = f"see {wrapped} here"
        base, spans = secrets.scan_deep(text)
        assert base == [] and (4, 0, 4 + len(wrapped.rstrip("="))) in [(a, k, b if text[b - 1] != "=" else len(text[:b].rstrip("="))) for a, k, b in spans]
    escaped = "".join(f"\\u{ord(c):04x}" for c in inner)
    assert secrets.scan_deep("a " + escaped)[1] == [(2, 0, 2 + len(escaped))]
    percent = quote(quote("token=abcdefghij", safe=""), safe="")
    assert [k for _, k, _ in secrets.scan_deep("q?" + percent)[1]] == [0]


def test_escaped_keywords_with_values_behind_spaces():
    for text in (r"p\u0061ssword: hunter2hunter2", "api&#95;key = abcdefgh1234", "password%3A hunter2hunter2", r"p\x61ssword : %68unter2hunter2"):
        assert (0, 0, len(text)) in secrets.scan_deep(text)[1], text
        assert secrets.redact(f"a {text} b") == "a [secret] b"
    text = "token= pass%77ord:hunter2hunter2"
    assert (7, 0, len(text)) in secrets.scan_deep(text)[1]


SECRET = "password=hunter2hunter2"


def hidden(text):
    """Kinds found in a text that shows no secret itself."""
    base, spans = secrets.scan_deep(text)
    assert base == [] and all(0 <= a < b <= len(text) for a, _, b in spans)
    return {k for _, k, _ in spans}


def test_base64_across_lines_alphabets_and_alignments():
    rnd = random.Random(5)
    noise = lambda n: "".join(rnd.choice("bcdfghjklmnpqrstvwxz ") for _ in range(n))
    for k in range(60):
        data = f"{noise(rnd.randint(20, 300))}{SECRET} {noise(rnd.randint(0, 200))}".encode()
        for packed in (data, zlib.compress(data), gzip.compress(data)):
            assert hidden("a\n" + base64.encodebytes(packed).decode() + "b") == {0}
            lines = base64.b64encode(packed).decode()
            wrapped = "\r\n  ".join(lines[i : i + 64] for i in range(0, len(lines), 64))
            assert hidden(f"x {wrapped}\nnext line") == {0}
            assert hidden("x " + base64.urlsafe_b64encode(packed).decode().rstrip("=") + " y") == {0}
            assert hidden("host/" + "p" * (k % 9) + "/" + lines) == {0}
            assert hidden("q" * (k % 5) + lines) == {0}


def test_members_streams_and_bare_deflate(monkeypatch):
    two = gzip.compress(b"first member") + gzip.compress(SECRET.encode())
    assert hidden(base64.b64encode(two).decode()) == {0}
    work = zlib.compressobj(9, zlib.DEFLATED, -15)
    bare = work.compress(b"words before " + SECRET.encode()) + work.flush()
    assert hidden(base64.b64encode(bare).decode()) == {0}
    assert hidden("q=" + quote(gzip.compress(SECRET.encode()), safe="")) == {0}
    assert hidden("".join(f"\\x{b:02x}" for b in zlib.compress(SECRET.encode()))) == {0}
    for _ in range(40):
        two = gzip.compress(two)
    assert hidden(base64.b64encode(two).decode()) == {0}
    monkeypatch.setattr(secrets, "PIECE", 1 << 12)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 8)
    for at in (0, 4090, 4096, 100_000, 999_990):
        long = b"x " * (at // 2) + SECRET.encode() + b" y" * 200_000
        assert hidden(base64.b64encode(gzip.compress(long)).decode()) == {0}


def test_data_that_unfolds_far_is_scanned_to_its_end():
    long = zlib.compress(bytes(80 << 20) + b"\n" + SECRET.encode())
    assert hidden(base64.b64encode(long).decode()) == {0}


def test_ends_on_cycles_and_hostile_input():
    assert secrets.scan_deep("%2525252525" * 200)[1] == []
    assert secrets.scan_deep("A" * 100000)[1] == []
    assert secrets.scan_deep(None) == ([], [])


def test_redaction_keeps_the_rest():
    assert secrets.redact("a token=abcdefgh1 b") == "a [secret] b"
    assert secrets.redact("clean text") == "clean text"
    assert secrets.redact(None) is None


def test_rows(spark):
    docs = spark.createDataFrame([(1, "token = abcdefgh"), (1, "token = abcdefgh"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(tuple(r) for r in secrets.find(docs).collect())
    assert [r[:4] for r in got] == [(1, 1, 0, 0), (1, 1, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0)]
    assert got[0][5] == "assign:0:16" and secrets.find(docs.limit(0)).count() == 0
    assert secrets.redacted(docs).count() == 4
