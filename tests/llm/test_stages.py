import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t):
    w = WORD.findall(t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_near_dedup_links_from_four_fifths_on(spark):
    import corpus_pipeline as p
    from wayloom.llm.oddsketch import near_duplicates

    r = random.Random(11)
    texts = {}
    for g in range(12):  # copies with 0 to 5 changed words: similarities of 1 to 0.72 with the first
        base = [f"w{r.randrange(10**6)}" for _ in range(160)]
        for k in range(6):
            w = list(base)
            for j in range(k):
                w[20 * (j + 1) + k] = f"x{r.randrange(10**6)}"
            texts[10 * g + k] = " ".join(w)
    sets = {i: shingles(t) for i, t in texts.items()}

    def kept(percent):
        comp = {i: i for i in sets}
        for _ in sets:
            for a in sets:
                for b in sets:
                    if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        comp[a] = comp[b] = min(comp[a], comp[b])
            if all(comp[c] == c for c in comp.values()):
                break
        return sorted(set(comp.values()))

    assert len(kept(80)) < len(kept(85))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], COLUMNS)
    assert sorted(r.doc_id for r in p.near_dedup(spark, docs, "").collect()) == kept(80)
    assert sorted(r.doc_id for r in near_duplicates(docs).where("kept").collect()) == kept(85)


def test_leaks_in_capitals_with_accents(spark):
    from wayloom.llm.leaks import leaked_passages

    items = {1: "où était la forêt enchantée là-bas près du château brûlé après l'été passé à chérir la fée",
             2: "größere Straßen führen über schöne Brücken später natürlich zurück nach Köln außer für müde Gäste",
             3: "el niño pequeño soñó también con él mañana según la canción del país más allá del corazón",
             4: "λόγος και έργος άλλος μέγας κόσμος όλος ποταμός μικρός δρόμος ξένος θεός βίος"}
    docs = spark.createDataFrame([(k, f"some words before {t.upper()} and some more", "xx", "s", 1) for k, t in items.items()] + [(9, "nothing of that kind here " * 9, "en", "s", 1)], COLUMNS)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.share for r in leaked_passages(docs, bench).collect()}
    assert got == {(k, k): 1.0 for k in items}


def test_addresses_in_texts_without_digits(spark):
    from wayloom.llm.pseudonyms import pseudonymise

    rows = [(1, "write to jane.doe@example.com today"), (2, "room 7, write to jane.doe@example.com today"), (3, "me @home. or @work"), (4, "jane.doe@example.com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonymise(docs).collect()}
    assert [got[k].n_found for k in (1, 2, 3, 4)] == [1, 1, 0, 1] and "jane" not in got[1].text
    assert got[2].text == "room 7, " + got[1].text and got[3].text == rows[2][1] and got[4].text in got[1].text


def test_mix_keeps_rows_without_doc_id_and_repeated_ones(spark):
    import corpus_pipeline as p
    from wayloom.llm.mixing import pareto_mix

    r = random.Random(5)
    rows = [(None if i % 3 == 0 else i // 5, "w " * r.randrange(5, 60) + f"n{i}", "en", "abc"[i % 7 % 3], 1) for i in range(400)] + [(None, None, None, "b", None), (1, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, COLUMNS)
    want, got = {}, {}
    for x in pareto_mix(docs).collect():
        want[x.source] = want.get(x.source, 0) + x.taken
    out = p.mix_sources(spark, docs, "").collect()
    for x in out:
        got[x.source] = got.get(x.source, 0) + len(x.text.split())
    assert got == {s: n for s, n in want.items() if n}
    assert any(x.doc_id is None for x in out) and out[0].asDict().keys() == {*p.COLUMNS, "copy"}
    drawn = [(x.text, x["copy"]) for x in out]
    assert len(set(drawn)) == len(drawn) and max(c for _, c in drawn) <= 3
