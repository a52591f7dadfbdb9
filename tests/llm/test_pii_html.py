"""Operators 1 and 6: attributes, class words and very large pages; names of all scripts, coreference, and texts rewritten piece by piece."""

from __future__ import annotations

import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from strataframe.llm import html_extract, pii

ARTICLE = "<article><p>Real words of an article here.</p></article>"


@pytest.mark.parametrize("around", ["<div style='overflow:hidden'>%s</div>", "<div aria-hidden='false'>%s</div>", "<div data-id='comments'>%s</div>", "<div data-hidden>%s</div>", "<div title='class=ad id=menu hidden'>%s</div>", "<form action=x>%s</form>", "<div data-class=\"ad\" data-role='menu'>%s</div>", "<div class=a class='ad'>%s</div>"])
def test_everyday_attributes(around):
    assert html_extract.extract(around % ARTICLE) == "Real words of an article here."


@pytest.mark.parametrize("attribute", ["hidden", "HIDDEN=''", "class='x ad'", "id=comments", "role=\"navigation\"", "style='color:red; display : none'", "aria-hidden=true", "a=1 class = sidebar b"])
def test_hidden_and_named_parts_go(attribute):
    assert html_extract.extract(f"<article><p>Words of an article.</p><div {attribute}><p>Not this.</p></div><p>More of them.</p></article>") == "Words of an article. More of them."


def test_class_words_of_contents():
    inside = "".join(f"<div class='{c}'>Part {k}.</div>" for k, c in enumerate(["cookies-recipe", "social-science", "menu-of-the-day", "ad-hoc-networks", "sharing-economy", "header-image", "footer-notes-explained"]))
    assert html_extract.extract(f"<article><p>First.</p>{inside}</article>") == "First. " + " ".join(f"Part {k}." for k in range(7))
    assert html_extract.extract("<p data-class='ad'>One.</p><p class='ad'>Two.</p>") == "One."


@pytest.mark.parametrize("source", ["<table>" + "<tr><td>cell text here</td></tr>" * 100_000, "<div>" * 100_000 + "deep", "<b>" * 100_000 + "deep", "<p>" + "<b><i>x</b>" * 50_000, "<div><span>" * 50_000 + "x", "</p>" * 100_000 + "<i>a</div>" * 50_000, "<p>" + "long " * 1_000_000])
def test_large_and_deep_pages(source):
    begin = time.time()
    page = html_extract.Page(source)
    own = page.path(page.best())
    assert page.text(page.at(own)).endswith(("here", "deep", "x", "a", "long")) and time.time() - begin < 20


# ---- PII ------------------------------------------------------------------------------------------------------------------------

SCHEMA = "doc_id long, text string, kind string, canon string, attempt long"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "x", "y", 3) for k, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.mark.parametrize("key", ["k1", "another"])
def test_names_of_all_scripts(spark, key):
    """Hundreds of names of each script: none keeps a part, given names keep gender and script, no two people become one."""
    rng = random.Random(7)
    surnames = {"latin": ["Smith", "Quill", "Brandt", "Okafor", "Tanaka"], "cyrillic": ["Иванова", "Петров", "Сидоров"], "greek": ["Παππάς", "Νικολάου", "Γεωργίου"]}
    people = sorted({f"{g} {s}{rng.choice(['', 'a', 'o']) if script == 'latin' else ''}" for (_, script), names in pii.GIVEN.items() for g in names for s in surnames[script]})
    texts = [f"Yesterday {p} came by." for p in people]
    out = {r.doc_id: r for r in pii.rewritten(docs_of(spark, texts), key).collect()}
    pool = {n: k for k, names in pii.GIVEN.items() for n in names}
    made = []
    for k, p in enumerate(people):
        assert out[k].n_entities == 1 and out[k].text.startswith("Yesterday ") and out[k].text.endswith(" came by.")
        new = out[k].text[10:-9]
        made.append(new)
        assert pool[new.split()[0]] == pool[p.split()[0]] and new.split()[0] != p.split()[0] and new.split()[1] != p.split()[1], (p, new)
    assert len(set(made)) == len(people) > 250 and not set(made) & set(people)


def test_a_surname_follows_its_person(spark):
    texts = ["Maria Lopez spoke. Later Lopez said no; Ms. Lopez left. LOPEZ'S case, Lopezian, Lopez-Bay.", "Lopez was here.", "ANNA SMITH and Ben Ito. Smith? Dr. Smith!", "Anna Smith-Jones met Smith-Jones. Smith stays."]
    out = {r.doc_id: r.text for r in pii.rewritten(docs_of(spark, texts), "key").collect()}
    new = out[0].split()[1]
    assert out[0].split(" spoke.")[1] == f" Later {new} said no; Ms. {new} left. {new.upper()}'S case, Lopezian, Lopez-Bay." and new != "Lopez"
    assert out[1] == texts[1]
    new = out[2].split()[1]
    assert out[2].endswith(f"and Ben Ito. {new.capitalize()}? Dr. {new.capitalize()}!") and new == new.upper() != "SMITH"
    new = out[3].split()[1]
    assert out[3].endswith(f" met {new}. Smith stays.") and "-" in new


def test_rewriting_by_brute_force(spark):
    """Found with another engine: what is between entities stays as it is, one entity has one surrogate everywhere, two never share one."""
    rng = random.Random(12)
    known = ["a.b@example.org", "x_y@mail.example.com", "10.0.0.1", "192.168.17.254", "4111 1111 1111 1111", "4111111111111111", "DE89 3704 0044 0532 0130 00", "123-45-6789", "+1 555 123 4567", "(555) 123-4567", "f" * 40, "AKIA" + "Q" * 16, "Anna Smith", "Иван Петров", "Νίκος Παππάς", "Wei Zhang", "2001:db8:0:0:0:ff00:42:8329"]
    plain = ["and", "so, ", "the 12th", "x=3;", "\n", "é", "…", "end. ", "(see", "no)", "-"]
    texts = [" ".join(rng.choice(known if rng.random() < 0.4 else plain) for _ in range(rng.randrange(1, 25))) for _ in range(200)] + ["", " ".join(known) * 300]
    pattern = regex.compile(pii.ENTITY)
    surrogate: dict[str, str] = {}
    for r in pii.rewritten(docs_of(spark, texts), "key").collect():
        at, text = 0, texts[r.doc_id]
        found = list(pattern.finditer(text))
        assert r.n_entities == len(found)
        for k, m in enumerate(found):
            before = text[(found[k - 1].end() if k else 0) : m.start()]
            assert r.text.startswith(before, at)
            at += len(before)
            new = surrogate.get(m[0])
            if new is None:
                name = regex.compile(r"\p{L}+ \p{L}+").match(r.text, at) if regex.fullmatch(r"\p{L}+ \p{L}+", m[0]) else None
                new = surrogate[m[0]] = name[0] if name else r.text[at : at + len(m[0])]
            assert r.text.startswith(new, at) and new != m[0], (m[0], new)
            at += len(new)
        assert r.text[at:] == text[found[-1].end() if found else 0 :]
    assert len(set(surrogate.values())) == len(surrogate) and not set(surrogate.values()) & set(surrogate)


def test_exceptions_of_rows_without_ids(spark, monkeypatch):
    """Rows with null and repeated ids that all need a second draw are rewritten each by its own contents."""
    texts = [f"see {a}.{b}.{c}.{d} now" for a in range(1, 4) for b in range(4) for c in range(4) for d in range(3)]
    docs = spark.createDataFrame([(None if k % 2 else 7, t, "x", "y", 3) for k, t in enumerate(texts)], SCHEMA)
    got = pii.rewritten(docs, "k")
    assert got.count() == len(texts) and got.select("text").distinct().count() == len(texts)
    assert not {r.text for r in got.collect()} & set(texts) and pii.exceptions(pii.entities(docs), "k").count()
    assert {r.doc_id for r in got.where(F.col("n_entities") == 1).collect()} == {None, 7}
