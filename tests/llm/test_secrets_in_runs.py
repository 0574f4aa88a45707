"""Keys inside runs that fit no alphabet as a whole."""

import random

from paperloom.llm import secrets


def key(rng, alphabet, n=40):
    return "".join(rng.choice(secrets.ALPHABETS[alphabet]) for _ in range(n - 1)) + "7"


def test_candidates_inside_runs():
    rng = random.Random(5)
    a, b = "x" + key(rng, "base64").replace("/", "+"), "x" + key(rng, "base64url").replace("-", "_")
    plus = "k7" + key(rng, "base62")[:20] + "+" + key(rng, "base62")[:20] + "/Q"
    for text, want in [
        (f"AWS_ACCESS_KEY={a} x", [a]),
        (f"STRIPE_KEY={b}&OTHER={a}", [b, a]),
        (f"see /v1/some-name/{b}/end", [b]),
        (f"some-prefix-{plus}", [plus]),
        (f"N={a}=", [a]),
        ("=" * 30 + "-" * 30, []),
        ("a1=b2=c3=d4=e5=f6=g7=h8=i9", []),
    ]:
        got = [text[x:y] for x, y, _, _ in secrets.candidates(text)]
        assert all(w in got for w in want) and (want or not got), (text, got)


def test_named_keys_are_found_and_redacted_like_bare_ones(spark):
    rng = random.Random(6)
    keys = [key(rng, "base62") for _ in range(40)]
    rows = [(k, f"export STRIPE_KEY={x} done") for k, x in enumerate(keys)] + [(100 + k, "NAME=version1version1version1version1 here") for k in range(40)]
    named = spark.createDataFrame(rows, "doc_id long, text string")
    bare = spark.createDataFrame([(k, t.replace("=", " ")) for k, t in rows], "doc_id long, text string")
    got, want = ({r.doc_id: r.spans for r in secrets.find_secrets(df).collect()} for df in (named, bare))
    assert got == want and sum(s == "random:18:58" for s in got.values()) > 20
    clean = {r.doc_id: r.text for r in secrets.redact(named).collect()}
    assert all((clean[k] == "export STRIPE_KEY=[SECRET] done") == bool(got[k]) for k in range(40))
