import re

import pytest

from plumbline.llm import secrets

KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def brute(text):
    spans = [
        (m.start(), k, name, m.end())
        for k, (name, regex, fits) in enumerate(KINDS)
        for m in re.finditer(regex, text or "")
        if fits(m)
    ]
    return [(name, a, b) for a, _, name, b in sorted(spans)]


HEX = "0123456789abcdef0123456789abcdef"
TEXTS = [
    None, "", "nothing here", f'token = "{HEX}" end', f"é\U0001f600 Password:hunter22 {HEX}{HEX}", "AKIA" + "A1" * 8 + " x AKIAAKIA" + "B" * 20,
    "secret=token:abcdefgh", "TOKEN==abcdefg api_key = 'abcdef' apikey:abcde", f"{HEX[:23]} {HEX[:24]}", "token=short token: longer1",
    "password" * 2000 + "=abcdefg", "token" + " " * 3000 + "=abcdefg", "a1" * 40_000, "API_KEY\"  =  \"x.y/z+w=\"", "passwd='123456'passwd=654321",
]


def test_base_spans_are_those_of_the_regexes(make_docs):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[3]), (3, TEXTS[3]), (3, TEXTS[4])]
    found = secrets.scan(make_docs(rows)).collect()
    got = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.rule < 3]) for r in found), key=repr)
    assert got == sorted(((d, brute(t)) for d, t in rows), key=repr)


def test_further_rules(make_docs):
    text = "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36 + " xoxb-1234567890 eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM"
    spans = secrets.scan(make_docs([(1, text)])).first().spans
    assert {s.kind for s in spans} >= {"private_key", "github", "slack", "jwt"}
    for s in spans:
        rule = secrets.RULES[s.rule]
        assert re.fullmatch(rule.regex, text[s.start : s.end])


@pytest.mark.parametrize("regex, sets", [
    ("abcd", [{"abc", "bcd"}]),
    ("abc|xyz", [{"abc"}, {"xyz"}]),
    ("ab?c", []),
    ("ABc+d", [{"abc"}]),
    ("a[bc]d", [{"abd"}, {"acd"}]),
    ("abc.*xyz", [{"abc", "xyz"}]),
    ("(?:abcd|abc)x?", [{"abc"}]),
    ("[0-9a-f]+", []),
    ("(abc)*", []),
    ("(abc){2,}", [{"abc"}]),
])
def test_trigrams_of_a_regex(regex, sets):
    assert sorted(map(sorted, secrets.trigrams(regex))) == sorted(map(sorted, sets))


def test_candidates_hold_every_match():
    """No match escapes the trigrams of its rule."""
    for rule in secrets.RULES:
        for text in TEXTS:
            if text and re.search(rule.regex, text) and secrets.trigrams(rule.regex):
                assert any(all(t in text.lower() for t in s) for s in secrets.trigrams(rule.regex))


def test_plan_has_no_python_and_empty_tables_pass(make_docs):
    docs = make_docs([(1, TEXTS[3])])
    plan = secrets.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)
    assert secrets.scan(docs.limit(0)).count() == 0
