"""Cases that a review found cut short."""

import random
from collections import Counter

import corpus_pipeline as p
from keyloom.llm import mixing, pii
from tests.llm import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], COLUMNS)


def test_stages_tell_rows_of_one_doc_id_apart(spark, tmp_path):
    text = [" ".join(f"w{k}x{j}" for j in range(30 + k)) for k in range(8)]
    rows = [(1, text[0], "a")] * 5 + [(None, text[1], "a")] * 3 + [(2, text[2], "a"), (2, text[3], "b"), (None, text[4], "b"), (7, text[5], "a"), (6, text[5] + " ", "a"), (None, text[2], "a"), (3, None, "b"), (None, "", "b")]
    exact = p.exact_copies(spark, corpus(spark, rows), "")
    got = [(r.doc_id, r.text) for r in exact.collect()]
    assert sorted(got, key=repr) == sorted([(1, text[0]), (None, text[1]), (2, text[2]), (2, text[3]), (None, text[4]), (6, text[5] + " "), (3, None)], key=repr)

    near = p.near_copies(spark, corpus(spark, rows), "")
    got = [(r.doc_id, r.text) for r in near.collect()]
    assert sorted(got, key=repr) == sorted([(1, text[0]), (None, text[1]), (2, text[2]), (2, text[3]), (None, text[4]), (6, text[5] + " "), (3, None)], key=repr)

    docs = corpus(spark, [(1, text[6], "a")] * 6 + [(None, text[7], "b")] * 4 + [(k, text[k % 6], "b") for k in range(10, 16)])
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in p.source_weights(spark, docs, "").collect()) == +want


def test_stages_drop_near_copies_of_similarity_08(spark):
    rnd = random.Random(7)
    rows = []
    for size, changed in [(500, 1), (500, 4), (500, 8), (200, 1), (200, 4), (60, 1), (60, 2), (60, 6)]:
        for _ in range(10):
            words = [f"v{rnd.randrange(5000)}" for _ in range(size)]
            other = list(words)
            for k in rnd.sample(range(size), changed):
                other[k] = "changed"
            rows += [(len(rows), " ".join(words), "a"), (len(rows) + 1, " ".join(other), "a")]
    words = [f"u{rnd.randrange(5000)}" for _ in range(300)]
    for k in range(60):  # a group in which each has one word of its own
        rows.append((len(rows), " ".join(words[: 5 * k] + [f"own{k}"] + words[5 * k + 1 :]), "a"))
    docs = corpus(spark, rows)
    for name, stage in p.STAGES[1:-2]:
        docs = stage(spark, docs, "")
    roots, links = brute.similar([r[:2] for r in rows])
    assert len(links) > 1000
    left, want = {r.doc_id for r in docs.collect()}, set(roots.values())
    assert want <= left and len(left - want) <= 0.05 * (len(rows) - len(want))  # nothing but copies goes, and nearly all of them


def terms_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    return {r.doc_id: sorted(text[r.doc_id][t.start : t.end] for t in r.terms) for r in pii.find_personal_data(df).collect()}


def test_copies_change_no_disclosing_term(spark):
    rows = [(k, f"the owner Zorblatt writes to boss@x.org from home {k}") for k in range(3)] + [(k, f"the owner of {k} writes from home to nobody") for k in range(3, 60)]
    copied = rows + [(100 + k, rows[k % 3][1]) for k in range(120)]
    once, often = terms_of(spark, rows), terms_of(spark, copied)
    assert once[0] == ["Zorblatt"] and all(often[k] == once[k] for k in range(60)) and often[100] == ["Zorblatt"]


def test_terms_are_found_anywhere_in_a_text(spark):
    far = " ".join(["and so on it goes"] * 40)
    rows = [(k, f"Zorblatt is the head {far} mail boss@x.org {k} {far} signed Quuxham, and again ZORBLATT") for k in range(4)] + [(k, f"the head is of {k} {far} mail signed and again") for k in range(4, 80)]
    rows += [(200, f"Zorblatt {far} and nobody else"), (201, f"see boss@x.org {far}")]
    got = terms_of(spark, rows)
    assert all(got[k] == ["Quuxham", "ZORBLATT", "Zorblatt"] for k in range(4))
    assert not any(got[k] for k in got if k > 3)
