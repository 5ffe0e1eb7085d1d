"""All rules at once against Python's re, rule by rule, with offsets in code points."""

import hashlib
import random
import re

from strataloom.llm import secrets


def expected(text: str) -> list[tuple[int, int, str]]:
    found = []
    for k, rule in enumerate(secrets.BASE + secrets.MORE):
        body = rule.body if rule.body.startswith("[") else f"[{rule.body}]"
        for m in re.finditer(f"({'(?i:' + rule.head + ')' if rule.fold else rule.head})({body}{{{rule.run},}})" if rule.head else f"()({body}+)", text):
            if len(m[m.lastindex]) >= rule.keep and len(m[0]) >= rule.least:
                found.append((m.start(), k, f"{rule.name}:{m.start()}:{m.end()}"))
    return sorted(found)


PIECES = ["é漢😀", " ", "\n", "password = ", "Token:", "abcdef", "AKIA", "ABCDEFGHIJKLMNOPQRST", "0123456789abcdef" * 2, "ghp_", "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "glpat-", "Zz9_-" * 5, "xoxb-", "1-2-3-4-5-6", "sk_live_", "rk_test_", "AIza", "q" * 35, "npm_", "sk_live", "_", "="]


def test_spans_of_all_rules(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    got = {r["doc_id"]: r for r in secrets.secret_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    kinds = set()
    for i, text in enumerate(texts):
        want = expected(text)
        kinds |= {x[1] for x in want}
        assert got[i]["spans"] == ",".join(x[2] for x in want), text
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(x[2] for x in want if x[1] < len(secrets.BASE)).encode()).hexdigest()
    assert kinds == set(range(len(secrets.BASE + secrets.MORE)))
