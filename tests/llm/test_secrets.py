import base64
import hashlib
import json
import re

from jobtrail.llm import secrets
from jobtrail.llm.tables import read
from tests.llm.helpers import SF


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x80 + (len(body).bit_length() + 7) // 8]) + len(body).to_bytes((len(body).bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def number(n, size):
    return der(0x02, (n % 256 ** (size - 1)).to_bytes(size, "big"))


RSA = der(0x30, number(0, 1), *(number(3**800 + i, 64) for i in range(8)))
ALGORITHM = der(0x30, der(0x06, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), der(0x05))
PKCS8 = der(0x30, number(0, 1), ALGORITHM, der(0x04, RSA))
PUBLIC = der(0x30, ALGORITHM, der(0x03, b"\x00" + RSA))
SSH = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(range(32))))


def token(header, claims):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return f"{part(header)}.{part(claims)}.{'s1G-_' * 6}"


def plain(text):
    """Base spans by the patterns as they are given."""
    text = text or ""
    word = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    out = [("assign", m.start(), m.end()) for m in re.finditer(rf"({word})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")


def test_base_spans_and_digest(spark):
    texts = [r.text for r in read(spark, SF, "documents").collect()]
    texts += [None, "", "é PassWord = 'abc123'", "token:short", "ſecret=abcdefgh toKen=abcdefgh", "api_key : \"A+/=._-x\" apikey=123456", "AKIA" + "B" * 16 + "x", "AKIA" + "B" * 15,
              "0123456789abcdef01234567", "0123456789abcdef0123456", "x" * 300_000 + " secret=abcdefg " + "f" * 24, "passwdtoken=abcdef=ghijkl", "secret=abc token=abcdef" * 3]
    got = {r.doc_id: r for r in secrets.digest(secrets.find_secrets(rows(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = plain(t)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[0] == k for s in want) for k in secrets.BASE_KINDS), t
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) - {""} <= set(got[i].spans.split(","))


def test_structures():
    assert all(map(secrets.is_der_key, (RSA, PKCS8, PUBLIC)))
    assert not any(map(secrets.is_der_key, (RSA[:-1], RSA + b"\x00", b"", b"\x30\x80", der(0x30, der(0x30, b"\x02")), der(0x04, RSA), der(0x30, number(1, 1), number(2, 1)))))
    deep = b""
    for _ in range(40):
        deep = der(0x30, deep)
    assert not secrets.is_der_key(deep)
    assert secrets.is_ssh_key(SSH) and not secrets.is_ssh_key(SSH[:-1]) and not secrets.is_ssh_key(b"\x00\x00\x00\x03abc")
    assert secrets.is_signed_token(token({"alg": "HS256"}, {"sub": 1})) and not secrets.is_signed_token(token({"typ": "x"}, {"sub": 1}))


def test_confirmed_spans():
    b64 = base64.b64encode(PKCS8).decode()
    lines = "\n".join(b64[i: i + 64] for i in range(0, len(b64), 64))
    text = f"é -----BEGIN KEY-----\n{lines}\n-----END KEY----- ssh {base64.b64encode(SSH).decode()} {RSA.hex().upper()} {token({'alg': 'HS256'}, {'sub': 1})} plain {'QUJD' * 20}"
    spans = [s for s in secrets.scan_text(text) if s[0] not in secrets.BASE_KINDS]
    assert [k for k, _, _ in spans] == ["der", "ssh", "der", "token"]
    assert text[spans[0][1]: spans[0][2]] == lines
    assert base64.b64decode(text[spans[1][1]: spans[1][2]]) == SSH
    # a body of random bytes is no key
    assert not secrets.scan_text(base64.b64encode(hashlib.sha512(b"x").digest()).decode().replace("f", "g"))


def test_redaction_and_edges(spark):
    docs = rows(spark, [f"a token = {'0123456789abcdef' * 2} b", None, "", "clean text", f"AKIA{'Z' * 20}"])
    got = {r.doc_id: r for r in secrets.redact(docs.unionByName(docs.limit(1))).collect()}
    assert [got[i].text for i in range(5)] == ["a [secret] b", None, "", "clean text", "[secret]"]
    assert got[0].spans == "clash"
    assert secrets.redact(docs.limit(0)).collect() == [] and secrets.find_secrets(docs.limit(0)).collect() == []
    assert all(not s.spans for s in secrets.find_secrets(secrets.redact(docs)).collect())


def confirmed(text):
    return [(k, text[a:b]) for k, a, b in secrets.scan_text(text) if k in ("der", "ssh")]


def lines_of(data, width=64):
    b64 = base64.b64encode(data).decode()
    return [b64[i: i + width] for i in range(0, len(b64), width)]


def test_keys_among_other_lines():
    """What stands behind a key does not hide it: a word, another key."""
    ed = der(0x30, number(0, 1), der(0x30, der(0x06, b"\x2b\x65\x70")), der(0x04, der(0x04, bytes(range(200, 232)))))
    one, two = base64.b64encode(ed).decode(), base64.b64encode(SSH).decode()
    assert len(one) == 64 and len(two) == 68
    for key, kind in ((one, "der"), (two, "ssh")):
        assert confirmed(f"key:\n{key}\nwords follow") == [(kind, key)]
        assert confirmed(f"words\n{key}\r\n    words") == [(kind, key)]
        assert confirmed(f"{key}\n{key}\nend") == [(kind, key)] * 2
    assert confirmed(f"{one}\n{two}") == [("der", one), ("ssh", two)]
    assert confirmed(f"{'QUJD' * 16}\n{one}\n{'QUJD' * 16}") == [("der", one)]
    # more on the key's own line: no key
    assert confirmed(f"{one}QUJD") == []


def test_every_last_line_and_kind_of_break():
    for extra in range(48):
        rsa = der(0x30, number(0, 1), *(number(3**800 + i, 64) for i in range(7)), number(3**800, 64 + extra))
        lines = lines_of(rsa)
        for gap in ("\n", "\r\n", "\n    ", " \n\t", "\\n", "\\r\\n", "\\\\n"):
            body = gap.join(lines)
            assert confirmed(f"-----BEGIN RSA PRIVATE KEY-----{gap}{body}{gap}-----END RSA PRIVATE KEY-----") == [("der", body)], (extra, gap)
    assert confirmed('{"private_key":"-----BEGIN PRIVATE KEY-----\\n' + (body := "\\n".join(lines_of(PKCS8))) + '\\n-----END"}') == [("der", body)]


def test_private_key_file():
    field = lambda x: len(x).to_bytes(4, "big") + x
    for tag in (b"", b"t" * 16):
        data = b"openssh-key-v1\x00" + b"".join(map(field, (b"none", b"none", b""))) + b"\x00\x00\x00\x01" + field(SSH) + field(bytes(range(136))) + tag
        body = "\n  ".join(lines_of(data, 70))
        assert confirmed(f"{body}\nwords\n{base64.b64encode(SSH).decode()}\nwords") == [("ssh", body), ("ssh", base64.b64encode(SSH).decode())]


def folded(data, width):
    text = base64.b64encode(data).decode()
    return "\n".join(text[i: i + width] for i in range(0, len(text), width))


def test_keys_folded_short():
    for data, kind in ((PKCS8, "der"), (PUBLIC, "der"), (RSA, "der"), (SSH, "ssh")):
        for width in (24, 32, 38, 64, 76):
            text = "note\n" + folded(data, width) + "\nend"
            assert [s for s in secrets.scan_text(text) if s[0] == kind] == [(kind, 5, len(text) - 4)], (kind, width)


def test_hostile_headers_cost_in_proportion():
    """Lines that each begin with a header that states far more than there is, or a little more than the line."""
    import time

    line = base64.b64encode(b"\x30\x84\x10\x00\x00\x00\x02\x01\x00" + b"\x04" * 39).decode()
    near = base64.b64encode(b"\x30\x82\x01\x00\x02\x01\x00" + b"\x04" * 41).decode()
    key = base64.b64encode(PKCS8).decode()
    for one in (line, near):
        began = time.time()
        text = (one + "\n") * 40_000 + "\n--\n" + key
        got = [s for s in secrets.scan_text(text) if s[0] == "der"]
        assert got == [("der", len(text) - len(key), len(text))]
        assert time.time() - began < 4
