"""Plain spans against the contract's expressions as they stand; disguises by example; spans map back."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def plain(text):
    out = {}
    for kind, pattern in PLAIN.items():
        out[kind] = []
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if fine:
                out[kind].append(m.span())
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@-_+0125 ()\né", max_size=60))
def test_plain_spans(text):
    assert pii.detect(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a@b.co", "x_y@c.d.e", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (319) 555-5132", " ", "_", ".", "@", "7"]), max_size=8))
def test_plain_spans_of_pieces(parts):
    text = "".join(parts)
    assert pii.detect(text) == plain(text)


def spans(text):
    base, added = pii.find(text)
    return [(k, text[a:b]) for k in pii.KINDS for a, b in added[k]], base


def test_disguises():
    for text, kind, part in [
        ("write to john.doe [at] example [dot] com today", "email", "john.doe [at] example [dot] com"),
        ("write john(at)example(dot)co(dot)uk.", "email", "john(at)example(dot)co(dot)uk"),
        ("mail me: jane at example dot com please", "email", "jane at example dot com"),
        ("mail jane dot doe at mail dot example dot org now", "email", "jane dot doe at mail dot example dot org"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("john＠example．com", "email", "john＠example．com"),
        ("call ＋４４ ２０ ７９４６ ０９５８ now", "phone", "＋４４ ２０ ７９４６ ０９５８"),
        ("call plus one three one nine five five five five one three two ok", "phone", "plus one three one nine five five five five one three two"),
        ("host one nine two dot one six eight dot zero dot one up", "ip", "one nine two dot one six eight dot zero dot one"),
        ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
    ]:
        found, _ = spans(text)
        assert (kind, part) in found, (text, found)


def test_clean_text_has_none():
    for text in ["", "Look at the dot on the page, one two three.", "He was at home (at last) and dotted [the] i.", "zero one two three four", "Café à 5 heures, le dot com boom at noon."]:
        base, added = pii.find(text)
        assert not any(base.values()) and not any(added.values()), (text, base, added)


def test_plain_spans_stay():
    text = "a@b.com and c [at] d [dot] com"
    base, added = pii.find(text)
    assert base["email"] == [(0, 7)] and added["email"] == [(12, 30)]
    assert pii.listed({k: base[k] + added[k] for k in pii.KINDS}) == "email:0:7,email:12:30"
    assert pii.redacted(text, {k: base[k] + added[k] for k in pii.KINDS}) == "[EMAIL] and [EMAIL]"


def test_long_runs_are_linear():
    assert pii.detect("a" * 300_000 + "1" * 300_000)["email"] == []


def test_rows(spark):
    df = spark.createDataFrame([(1, "x a@b.com", 5), (2, None, 6), (None, "", 7), (1, "x a@b.com", 5)], "doc_id long, text string, _row long")
    rows = sorted(pii.personal_data(df, carry=["doc_id", "_row"]).collect(), key=str)
    assert [(r.doc_id, r.n_email, r.spans, r.redacted) for r in rows if r.doc_id == 1] == [(1, 1, "email:2:9", "x [EMAIL]")] * 2
    assert {(r.doc_id, r.spans, r.redacted) for r in rows if r.doc_id != 1} == {(2, "", None), (None, "", "")}
    assert pii.personal_data(df.limit(0), carry=["doc_id"]).count() == 0


def test_runs_of_few_names_and_other_endings():
    for text, kind, part in [
        ("host 192 dot 168 dot 0 dot 1 is up", "ip", "192 dot 168 dot 0 dot 1"),
        ("server one 192 dot 168 dot 0 dot 1 is up", "ip", "192 dot 168 dot 0 dot 1"),
        ("host 192 dot 168 dot zero dot 1 is up", "ip", "192 dot 168 dot zero dot 1"),
        ("call +1 415 five five five 0199 now", "phone", "+1 415 five five five 0199"),
        ("call plus four four 20 7946 0958 now", "phone", "plus four four 20 7946 0958"),
        ("card 4111 1111 1111 111 one end", "card", "4111 1111 1111 111 one"),
        ("card ４１１１ １１１１ １１１１ １１１１ one end", "card", "４１１１ １１１１ １１１１ １１１１"),
        *[(f"mail jane at example dot {e} please", "email", f"jane at example dot {e}") for e in "ai jp au ru app info museum xn--p1ai".split()],
        ("jane arroba example punto me", "email", "jane arroba example punto me"),
    ]:
        found, _ = spans(text)
        assert found == [(kind, part)], (text, found)
    for text in ["We are at this point in time, so one 12 or two 14.", "He stood at the dot in the middle.", "In 2019 one of 300 dot 4 dot 5 dot 6 was 7.", "from one 1 to two 2 at point 3", "Look at main.py and at build.sh first."]:
        base, added = pii.find(text)
        assert not any(base.values()) and not any(added.values()), (text, base, added)


DISGUISED = [
    ("email", "jane at example dot com"), ("email", "jane [at] example [dot] com"), ("email", "j.doe at mail dot example dot org"), ("email", "jane dot doe at example dot net"), ("email", "j(at) example (dot)com"),
    ("email", "jоhn＠exаmple．com"), ("ip", "192 dot 168 dot 0 dot 1"), ("ip", "one nine two dot one six eight dot zero dot one"), ("phone", "plus one three one nine five five five five one three two"), ("card", "four one one one one one one one one one one one one one one one"),
]
BEFORE = st.lists(st.sampled_from(["the", "at", "look at", "in", "point", "é", "(at)", "write to", "he [was]", "dotted", "x,"]), max_size=4).map(" ".join)
AFTER = st.lists(st.sampled_from(["the", "at noon", "at home", "dot the", "in", "point taken", "é", "and at", "(dots)", "at last"]), max_size=4).map(" ".join)


@settings(max_examples=400, deadline=None)
@given(BEFORE, st.sampled_from(DISGUISED), AFTER)
def test_disguised_among_words(before, what, after):
    """Whatever stands beside it, a disguised identifier is found, from its first character to its last."""
    kind, part = what
    text = f"{before} and {part} {after}."
    base, added = pii.find(text)
    assert any(text[a:b] == part for a, b in added[kind]), (text, added)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab @.", max_size=20), st.lists(st.tuples(st.integers(0, 25), st.integers(0, 6), st.text(alphabet="xy", max_size=3)), max_size=5))
def test_rewritten_text_maps_back(text, edits):
    """Edits of any places: what is left of the source maps to itself, what is new to what it replaces."""
    edits = pii.apart([(a, min(a + n, len(text)), new) for a, n, new in edits if a < len(text)])
    out = pii.Rewritten(text)
    out.replace(edits)
    want, at = [], 0
    for a, b, new in edits:
        assert at <= a < b
        want += [(text[k], k, k + 1) for k in range(at, a)] + [(c, a, b) for c in new]
        at = b
    want += [(text[k], k, k + 1) for k in range(at, len(text))]
    assert out.text == "".join(c for c, _, _ in want)
    if edits:
        assert [out.source((k, k + 1)) for k in range(len(want))] == [(a, b) for _, a, b in want]


def test_words_that_follow_an_address():
    for text, part in [
        ("please write jane at example dot com at noon", "jane at example dot com"),
        ("ask bob dot ray at mail dot com at once", "bob dot ray at mail dot com"),
        ("x at a dot com at b dot com", "x at a dot com"),
        ("see a(at) (dot) at b(at)c (dot) com", "b(at)c (dot) com"),
    ]:
        assert spans(text)[0] == [("email", part)], text
