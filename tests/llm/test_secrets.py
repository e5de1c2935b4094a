"""Operator 13 against a plain scan, and on planted strings."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import string

import public_tokenizers
import pytest
import tiktoken

from feedforge.llm import queries as registered
from feedforge.llm import secrets
from tests.llm.conftest import SMALL, odd_rows

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [(r[0], r[1]) for r in odd_rows()]


def brute_base(text):
    """The three kinds as they are worded: matches first, lengths after."""
    out = []
    for k, (pattern, group, least) in enumerate((
        (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        (r"AKIA[A-Z0-9]+", 0, 20),
        (r"[0-9a-f]+", 0, 24),
    )):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(out)


def brute_random(text, base):
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    taken = {p for a, _, b in base for p in range(a, b)}
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
        run = m.group()
        digits, upper, lower = (sum(c in s for c in run) for s in (string.digits, string.ascii_uppercase, string.ascii_lowercase))
        bare = "".join(c for c in run if c not in "+/_=-")
        digest = re.fullmatch(r"((md5|sha-?(1|224|256|384|512))[-_=/]?)?[0-9a-f]+", run, re.I) and len(re.sub(r"^(md5|sha-?(1|224|256|384|512))[-_=/]?", "", run, flags=re.I)) in (32, 40, 56, 64, 96, 128)
        known = digest or secrets._IDENTIFIER.fullmatch(run)
        if (digits and upper + lower or min(upper, lower) >= 3) and not known and not taken & set(range(m.start(), m.end())):
            out += [(m.start(), 3, m.end())] * (len(bare) < secrets.LIMIT * len(encoding.encode_ordinary(bare)))
    return out


def row(i, text):
    text = text or ""
    base = brute_base(text)
    say = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (i, *(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(say(base).encode()).hexdigest(), say(base + brute_random(text, base)))


def test_query(spark, texts):
    found = registered.queries()["op13_secret_scan"](spark, SMALL)
    assert found.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert sorted(tuple(r) for r in found.collect()) == [row(i, t) for i, t in sorted(texts.items())]


def planted():
    rng = random.Random(7)
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    word = string.ascii_letters + string.digits
    return [
        'PassWord: "hunter22" and passwd=abc then secret = x.y=z/12', "api_key='abcdef' apikey:abcde API_KEY = 123456", "toKen=ab toſken=abcdefgh Key token\t=abcdef token  :  'a-b_c.d", "secret==abcdef secret=secret=abcdef",
        "AKIA" + "A1" * 8, "AKIA" + "A1" * 7, "AKIAAKIA" + "B2" * 6, "xAKIA" + "C3" * 10 + "token=AKIA" + "D4" * 9,
        "0123456789abcdef" * 2, "0123456789abcdef0123456", "0123456789ABCDEF" * 2, "é" * 50 + "fff" * 9 + " 漢字 " + "0" * 24, "token = " + "f0" * 20,
        f"key {some(word, 32)} and {some(word, 20)}", f"Bearer {some(word + '-_', 43)}, {some(word + '+/', 86)}==", "a" * 100_000 + "1", "Zz9" * 20_000, " ".join(some(word, 24) for _ in range(300)),
        "550e8400-e29b-41d4-a716-446655440000 550E8400-E29B-41D4-A716-446655440000", hashlib.md5(b"x").hexdigest().upper(), "sha256-" + hashlib.sha256(b"x").hexdigest(), "2024-01-31T10-20-30Z 4785380592391139 1234-5678-9012-3456-78",
        "getHttpResponseCodeV2 my_long_variable_name_2 feature-branch-name-2024-01 ConnectionPoolManager2 einheitvererbeeinheitkeiter THIS_IS_A_CONSTANT_NAME_2",
    ]


def test_planted_strings(spark):
    rows = list(enumerate(planted()))
    got = registered.secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY).sort("doc_id").collect()
    said = [",".join(f"{s.kind}:{s.start}:{s.stop}" for s in r.spans) for r in got]
    assert said == [row(i, t)[-1] for i, t in rows]
    kinds = [[s.kind for s in r.spans] for r in got]
    assert kinds[13].count("random") == 2 and kinds[14].count("random") == 2 and kinds[17].count("random") >= 295
    assert kinds[18:] == [[], [], ["hex"], [], []]


def test_odd(spark, odd, none):
    got = secrets.scan_secrets(odd, VOCABULARY).collect()
    assert sorted((str(r.doc_id), [tuple(s) for s in r.spans]) for r in got) == sorted((str(i), [(secrets.KINDS[k], a, b) for a, k, b in brute_base(t or "") + brute_random(t or "", brute_base(t or ""))]) for i, t in ODD)
    assert secrets.scan_secrets(none, VOCABULARY).count() == 0
    left = secrets.redact_secrets(odd, VOCABULARY)
    assert left.columns == odd.columns and sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted((str(i), t or "") for i, t in ODD)


def test_redacted(spark):
    df = spark.createDataFrame([("x token = " + "f0" * 20 + " y AKIA" + "A1" * 8, 1, None), (None, 2, "t")], "text string, doc_id long, spans string")
    assert [r.text for r in secrets.redact_secrets(df, VOCABULARY).sort("doc_id").collect()] == ["x [assign] y [access]", None]


@pytest.mark.parametrize("alphabet", [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "-_"])
def test_random_strings_are_found(alphabet):
    rng = random.Random(11)
    runs = ["".join(rng.choice(alphabet) for _ in range(32)) for _ in range(500)]
    assert sum(bool(secrets.random_spans(r, [], VOCABULARY)) for r in runs) >= 495


def test_prose_is_left_alone(texts):
    """No run of the documents' prose counts as random."""
    assert not [s for t in texts.values() for s in secrets.spans_of(t, VOCABULARY) if s[1] == 3]
