"""Novel strings: precision and recall on a labelled set, the same spans as by brute force, whole lengths, and what is measured."""

import random
import re
import string

import pytest

from tests.llm.test_text_operators import prose
from tidemark.llm.secrets import PREFIXES, SENSITIVE, SENSITIVE_WORDS, Novelty, base_spans, identifiers, novel_spans, redact, scan_secrets

B62 = string.ascii_letters + string.digits
ALPHABETS = (B62, B62 + "+/", B62 + "-_", string.ascii_letters, string.ascii_lowercase + string.digits)
NO_SECRETS = """get_current_user_permissions create_database_connection validateRequestParameters ConfigurationManagerFactory com.example.app.service.UserRepositoryImpl src/main/java/com/example/Application.java
usr/local/share/applications/config.yaml www.wikipedia.org/wiki/Authentication_protocol Rechtsschutzversicherungsgesellschaften Donaudampfschifffahrtsgesellschaft anticonstitutionnellement incomprehensibilities
internationalization MAX_CONNECTION_RETRY_COUNT DEFAULT_BUFFER_SIZE_IN_BYTES test_user_login_with_invalid_password react-native-async-storage node_modules/.bin/webpack-dev-server application/x-www-form-urlencoded
2024-01-15T10:30:00.000Z 192.168.100.200.example.net org.springframework.boot.autoconfigure python3.11-slim-bookworm ubuntu-22.04.3-live-server this-is-a-very-long-article-title about-the-history-of-computing
session_token_expiry_seconds refreshAccessTokenHandler password_reset_confirmation_email authorization_code_grant_type passwordConfirmationField etc/ssl/certs/ca-certificates.crt telecommunications
Unabhaengigkeitserklaerung responsabilidades-compartidas understanding-and-respect one.two.three.four.five.six 1234567890123456 0000000000000000 your_api_key_here-replace-me xxxxxxxxxxxxxxxxxxxx""".split()
CONTEXTS = ("Authorization: Bearer %s", "the password is %s for now", "%s is the password", "my_secret_%s", "connect to db://admin:%s@host/base", "private key %s", "set auth \"%s\"", "its signing key, '%s',", "jwt %s;", "cookie %s")


def make(rng, n, of=B62):
    return "".join(rng.choice(of) for _ in range(n))


def novel(text, measure=Novelty()):
    return [text[s:e] for s, _, e in novel_spans(text, [], measure, 0.5)]


def test_precision_and_recall():
    rng, hits, due, wrong, clean = random.Random(21), 0, 0, 0, 0
    for of in ALPHABETS:
        for n in (16, 20, 24, 32, 40, 64, 200):
            for context in CONTEXTS:
                key = make(rng, n - 2, of) + make(rng, 2)  # no punctuation at the end
                got = novel(f"{prose(rng, 30)} {context % key} {prose(rng, 30)}")
                due += 1
                hits += len(got) == 1 and got[0].endswith(key.lstrip("-.~"))
    for context in CONTEXTS:
        for word in NO_SECRETS:
            clean += 1
            wrong += bool(novel(f"{prose(rng, 30)} {context % word} {prose(rng, 30)}"))
    assert hits >= 0.95 * due and wrong <= 0.02 * clean and hits / (hits + wrong) >= 0.95, (hits, due, wrong, clean)


def by_force(text, measure):
    """Every string, every word; no blocks of lines."""
    words = [m.span() for w in SENSITIVE for m in re.finditer(re.escape(w), text, re.I | re.A)] + [m.span() for w in SENSITIVE_WORDS for m in re.finditer(f"(?<![a-z]){w}(?![a-z])", text, re.I | re.A)]
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_~.-]{16,}={0,2}", text):
        s, e = m.span()
        while e > s and text[e - 1] in ".~-":
            e -= 1
        while s < e and text[s] in ".~-":
            s += 1
        near = any(s - 48 <= b <= e or e <= a <= e + 32 for a, b in words) or text[s:].startswith(PREFIXES) or text[max(0, s - 1) : s] == ":" and text[e : e + 1] == "@"
        if e - s >= 16 and near and measure(text[max(0, s - 256) : s], text[s:e], text[e : e + 128]) >= 0.5:
            out.append(text[s:e])
    return out


def test_spans_as_by_brute_force():
    rng, measure, some = random.Random(4), Novelty(), 0
    for _ in range(150):
        parts = [rng.choice([prose(rng, rng.randint(1, 12)), make(rng, rng.randint(12, 40)), rng.choice(SENSITIVE), rng.choice(SENSITIVE_WORDS), rng.choice(NO_SECRETS), rng.choice(PREFIXES) + make(rng, 20), "a:" + make(rng, 18) + "@b"]) for _ in range(rng.randint(1, 14))]
        text = " ".join(parts)
        assert novel(text, measure) == by_force(text, measure)
        some += bool(novel(text, measure))
    assert some > 50


def test_edges_of_a_secret():
    rng, key = random.Random(2), "q7XvB2mK9sLw4TzR8yHcJ3"
    assert novel(f"set my_secret_{key} now") == [f"my_secret_{key}"] and novel(f"token {key}. Then") == [key]
    assert novel(f"password {key} and again password {key}") == [key, key]
    long = make(rng, 6000)
    text = f"the secret={long} and bearer {long}"
    assert redact(text, ",".join(f"{k}:{s}:{e}" for s, k, e in base_spans(text) + novel_spans(text, base_spans(text), Novelty(), 0.5))) == "the <secret> and bearer <secret>"
    assert novel(f"sk_live_{key}") == [f"sk_live_{key}"] and novel(f"see {key} there") == []


def test_what_is_measured(spark, docs_of):
    key = "q7XvB2mK9sLw4TzR8yHcJ3"
    got = {r["doc_id"]: r for r in scan_secrets(docs_of([(1, f"secret={key}"), (2, "the token get_current_user_permissions"), (3, "x"), (4, f"the passcode: {key}")])).collect()}
    s, e, x = got[1]["novelty"].split(":")
    assert (int(s), int(e)) == (7, 7 + len(key)) and float(x) >= 0.5 and got[1]["n_novel"] == 0 and got[1]["n_assign"] == 1
    assert float(got[2]["novelty"].split(":")[2]) < 0.5 and got[2]["spans"] == "" and got[3]["novelty"] == ""
    assert got[4]["spans"] == f"novel:14:{14 + len(key)}"


@pytest.mark.parametrize(("text", "want"), [("getUserName", "getUserName"), ("a-b.c", "a-b.c"), ("q7XvB2mK9sLw", " "), ("2024-01-15", "2024-01-15"), ("v2/q7XvB2mK9sLw/list", "v2/ /list")])
def test_identifiers(text, want):
    assert identifiers(text) == want
