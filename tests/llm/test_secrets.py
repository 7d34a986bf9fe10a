"""Secret scans against a loop over regular expressions and whole-window entropies."""

import random
import string
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from plantscope.llm import secrets  # noqa: E402

SCHEMA = "doc_id long, text string, spans string"


def texts():
    rng = random.Random(5)
    b64 = string.ascii_letters + string.digits + "+/_=-"
    yield from [None, "", "token=key", "token=secret=abcdefgh x", 'PassWord" : "hunter22"', "api_key='abc' apikey=abcdef"]
    yield from ["ſecret=abcdefg \U0001f600 secret:abcdefg", "AKIAAKIA" + "X" * 13, "AKIA" + "A" * 15, "é" * 3 + "0" * 24]
    yield from ["0a" * 12 + " token: " + "f" * 30, "\n".join(["secret=aaaaaa"] * 50), "123e4567-e89b-12d3-a456-426614174000"]
    for n in (20, 21, 40, 300):
        yield "x " + "".join(rng.choices(b64, k=n)) + " y " + "".join(rng.choices("0123456789ABCDEF", k=n))
        yield "é" + "".join(rng.choices("ab1", k=n)) + "".join(rng.choices(b64, k=n)) + "example"[: n % 8]
    key, uid = "q7Rz/Kp2Lw9+Xt4Bv8Nc1Yd6", "123e4567-e89b-12d3-a456-426614174000"
    yield from ["/example/" + key, uid + "-" + key, key + uid + "Example" + key, key + "=EXAMPLE" + key[:9] + "dummy" + key]
    yield from ["deadbeef" * 4 + key, key + "AKIA" + "Q7" * 10 + key, "token=" + key + " " + key, "0123456789" + uid + key]
    words = ["token", "=", ":", " ", "'", "AKIA", "secret", "api_key", "\n", "é", "deadbeef", "Zq9_", "\U0001f600", '"']
    for _ in range(150):
        yield "".join(rng.choices(words, k=60))
    yield "word " * 50_000 + "token = abcdef0123"


def test_same_as_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in secrets.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        base, every = brute.secrets(t, secrets.WINDOW, secrets.CLASSES, secrets.ALLOWED_STRINGS)
        assert got[i].spans == brute.joined(every), t
        assert got[i].base_sha256 == brute.sha(brute.joined(base))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(
            sum(k == x for *_, k in base) for x in ("assign", "access", "hex")
        )
    assert any("entropy_base64" in r.spans for r in got.values())
    assert any("entropy_hex" in r.spans for r in got.values())


def test_redaction_hides_every_span(spark):
    rows = [(1, "a token=abcdef b AKIA" + "Q7" * 10 + " c", "x"), (2, None, "x"), (3, "é clean", "x")]
    got = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "a [secret] b [secret] c", 2: None, 3: "é clean"}


def test_allowed_stretches_are_cut_out_of_a_run(spark):
    key, uid = "q7Rz+Kp2Lw9+Xt4Bv8Nc1Yd6", "123e4567-e89b-12d3-a456-426614174000"
    rows = [(1, f"see example/{key} ", "x"), (2, f"{uid}{key}", "x"), (3, uid, "x"), (4, "example/" * 5 + "a1", "x")]
    rows += [(5, f"{uid}{key}", "x"), (5, f"{uid}{key}", "x")]
    got = sorted((r.doc_id, r.text) for r in secrets.redact(spark.createDataFrame(rows, SCHEMA)).collect())
    assert all(key not in t for _, t in got) and len(got) == 6
    texts = dict(got)
    assert texts[1].startswith("see example") and "[secret]" in texts[1]
    assert texts[2] == texts[5] == f"{uid}[secret]" and (texts[3], texts[4]) == (uid, rows[3][1])


def test_empty_table(spark):
    assert secrets.digest(spark.createDataFrame([], SCHEMA)).collect() == []
