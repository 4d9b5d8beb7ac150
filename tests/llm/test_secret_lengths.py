"""Secrets of any length are one candidate and go as a whole."""

import random
import string

import pytest

from llm_helpers import documents
from logweave.llm import secrets


@pytest.mark.parametrize("size", [300, 1000, 100_000])
def test_long_secrets_are_redacted_whole(spark, size):
    rng = random.Random(size)
    made = lambda n, signs="": "".join(rng.choice(string.ascii_letters + string.digits + signs) for _ in range(n))
    value, token = made(size), f"eyJ{made(40)}.{made(size)}.{made(43)}"
    login = f"{made(size)}:{made(size, '!')}!x"
    bare = made(size)
    texts = [f'see token = "{value}" end', f"see password: {value} end", f"token={token} end", f"go https://{login}@host.org/x end", f"run {bare}== end"]
    wanted = [value, value, token, login, bare + "=="]
    forest = secrets.fit(secrets.labelled_findings(spark))
    docs = documents(spark, texts)
    found = {r["doc_id"]: r["candidate"] for r in secrets.scan(docs, forest).collect()}
    assert [found[k] for k in range(len(texts))] == wanted
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs, forest).collect()}
    assert [out[k] for k in range(len(texts))] == [t.replace(w, "[SECRET]") for t, w in zip(texts, wanted, strict=True)]
