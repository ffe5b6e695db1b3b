from chainspark.llm import licenses as L
from tests.llm import plain


def shingles(text):
    w = plain.terms(text)
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)}


def named(own, sets):
    """Names of the templates whose shingles, and those that tell them from near ones, are in a text's."""
    out = set()
    for name, s in sets:
        near = [s - u for other, u in sets if other != name and len(s - u) <= 0.5 * len(s)]
        if len(s & own) >= 0.8 * len(s) and all(len(m & own) >= 0.8 * len(m) for m in near):
            out.add(name)
    return sorted(out)


def test_every_notice_names_its_own_license(spark):
    """Notices of one family differ in a version or a clause; none is taken for another."""
    extra = [("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
             ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
             ("CC-BY-NC-SA-4.0", "(c) them. This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.")]
    rows = [(i, text, name) for i, (name, text) in enumerate([*L.TEMPLATES, *extra])]
    got = {r["doc_id"]: r["licenses"] for r in L.license_windows(spark.createDataFrame(rows, "doc_id bigint, text string, want string")).collect()}
    for i, _, name in rows:
        assert got[i] == [name], (got[i], name)
    both = "\n".join(text for name, text in L.TEMPLATES if name in ("BSD", "BSD-3-Clause"))
    assert L.license_windows(spark.createDataFrame([(1, both)], "doc_id bigint, text string")).first()["licenses"] == ["BSD", "BSD-3-Clause"]


def test_notices_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = dict(docs.collect())
    sets = [(name, shingles(t)) for name, t in L.TEMPLATES]
    for r in L.license_windows(docs).collect():
        own = shingles(texts[r["doc_id"]])
        assert r["licenses"] == named(own, sets)
        assert r["n_words"] == len(plain.terms(texts[r["doc_id"]]))
        for f in r["found"]:
            w = plain.terms(texts[r["doc_id"]])[f["first_word"]:f["first_word"] + f["words"]]
            assert max(len(s & shingles(" ".join(w))) / len(s) for n, s in sets if n == f["license"]) >= 0.8


def test_edited_notices_inside_long_texts(spark):
    noise = " ".join(f"n{i}" for i in range(5000))
    mit = next(t for n, t in L.TEMPLATES if n == "MIT" and len(t) > 100)
    rows = [(i, noise[:i * 37] + " " + mit.upper().replace("ANY PERSON", "SOME PERSON") + " " + noise) for i in range(1, 40)]
    rows += [(100, mit[:150]), (101, None), (102, ""), (103, "MIT License"), (None, mit), (104, mit + "\n" + mit)]
    got = {r["doc_id"]: r for r in L.license_windows(spark.createDataFrame(
        [(*r, 1) for r in rows], "doc_id bigint, text string, licenses int")).collect()}
    assert all(got[i]["licenses"] == ["MIT"] for i in [*range(1, 40), None, 104])
    assert all(got[i]["licenses"] == [] for i in (100, 101, 102, 103))
    assert L.license_windows(plain.empty_documents(spark)).count() == 0


def test_bands_follow_from_the_probability():
    t = L.Templates([("x", "a b c d e f g h")], 0.8, 0.999)
    worst = 0.8 * 6 / (16 + 0.2 * 6)
    assert 1 - (1 - worst) ** t.bands >= 0.999 > 1 - (1 - worst) ** (t.bands - 1)
