import random

from lithoflow.llm import canonical

ORGS = [(1, "Dalloova Centre for Polymer Chemistry", ["Zentrum für Polymerchemie Dalloova", "CPCDAL"]), (2, "University of Denfufjord", ["Universität Denfufjord", "UDEN"]), (3, "Denfufjord University of Technology", ["Technische Universität Denfufjord"]), (4, "Institute for Ceramics, Nensohaven", None)]
ROLES = [(1, "ContactPerson", ["contact", "PI"]), (2, "DataCurator", ["data curation"]), (3, "Editor", ["editing"]), (4, "Other", ["miscellaneous"])]


def index(rows):
    strings = [(i, t) for i, l, a in rows for t in [l, *(a or [])]]
    weights = canonical.Weights()
    for _, t in strings:
        weights.add(t)
    return canonical.Index(strings, weights)


def best(ix, value):
    s = sorted(((v, i) for i, v in ix.best(value).items()), reverse=True)
    return s[0][1] if s and s[0][0] >= canonical.LEAST_SCORE and (len(s) < 2 or s[0][0] - s[1][0] >= canonical.MARGIN) else 0


def test_organisations():
    ix = index(ORGS)
    for value, want in [("dalloova center f. polymer chem.", 1), ("Dept. of Physics, Dalloova Centre for Polymer Chemistry", 1), ("Zentrum fuer Polymerchemie Dalloova", 1), ("cpcdal", 1), ("Univ. Denfufjord", 2), ("Univresity of Denfufjrod", 2), ("TU Denfufjord", 3), ("Nensohaven, Institute for Ceramics; Building 4", 4), ("University of Gazaminster", 0), ("Institute for Metallurgy, Nensohaven", 0), ("unknown", 0), ("???", 0), ("x" * 5000, 0)]:
        assert best(ix, value) == want, value


def test_roles():
    ix = index(ROLES)
    for value, want in [("Contact Person", 1), ("contact_person", 1), ("Conatct Person", 1), ("Data Curator 2018", 2), ("data curation team", 2), ("DtaCurator", 2), ("Eidtor", 3), ("Otrhe", 4), ("welder", 0), ("bus driver", 0), ("N/A", 0)]:
        assert best(ix, value) == want, value


def test_edits_against_plain_distance():
    def plain(a, b):
        d = {(i, j): max(i, j) if not min(i, j) else None for i in range(len(a) + 1) for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    words = ["", "a", "editor", "eidtor", "edtr", "ediotr", "curator", "cuartor"]
    assert all(canonical.edits(a, b) == plain(a, b) for a in words for b in words)


def test_table(spark):
    ref = spark.createDataFrame(ORGS, "org_id bigint, label string, aliases array<string>")
    rows = spark.createDataFrame([(1, "CPCDAL"), (1, "CPCDAL"), (2, "University of Denfufjord"), (3, None), (4, "  "), (5, "Elsewhere Ltd."), (6, "CPCDAL")], "row_id bigint, value string")
    got = canonical.find(rows.selectExpr("*", "1 AS score", "2 AS ref_id"), ref, "org_id")
    assert sorted((r["row_id"], r["ref_id"]) for r in got.collect()) == [(1, 1), (5, 0), (6, 1)]
    assert canonical.find(rows.limit(0), ref, "org_id").count() == 0
    assert {r["ref_id"] for r in canonical.find(rows, ref.limit(0), "org_id").collect()} == {0}


def test_blocks_of_the_reference_list(spark, monkeypatch):
    ref = spark.createDataFrame(ORGS, "org_id bigint, label string, aliases array<string>")
    rows = spark.createDataFrame([(1, "CPCDAL"), (2, "Univ. Denfufjord"), (3, "Inst. for Ceramics, Nensohaven")], "row_id bigint, value string")
    values, texts = rows.select("value").distinct(), canonical.strings(ref, "org_id")
    whole = {r["value"]: (r["ref_id"], r["score"]) for r in canonical.map_values(values, texts).collect()}
    monkeypatch.setattr(canonical, "BLOCK", 2)
    assert {(r["row_id"], r["ref_id"]) for r in canonical.find(rows, ref, "org_id").collect()} == {(1, 1), (2, 2), (3, 4)}
    assert {r["value"]: (r["ref_id"], r["score"]) for r in canonical.map_values(values, texts).collect()} == whole


def test_retrieval_against_brute_force():
    """Every entry that the score accepts for a mistyped or abbreviated form of it is retrieved."""
    rng = random.Random(8)
    kinds, fields = ("Institute", "Laboratory", "Centre", "University", "Academy"), ("Ceramics", "Metallurgy", "Polymer Chemistry", "Marine Geology", "Thin Films")
    rows = [(k, f"{rng.choice(kinds)} for {rng.choice(fields)} {''.join(rng.choice('bdfgklmnprst') + rng.choice('aeiou') for _ in range(4))}", None) for k in range(300)]
    ix = index(rows)
    accepted = retrieved = 0
    for k, label, _ in rows:
        words = label.split()
        at = rng.randrange(len(words[-1]) - 1)
        words[-1] = words[-1][:at] + rng.choice("xyz") + words[-1][at + 1 :]
        words[0] = words[0][: rng.choice((4, 5, 20))]
        reading = canonical.fold(" ".join(words))
        found = set(ix.candidates(reading))
        for n in range(len(ix.entries)):
            if ix.score(reading, n) >= canonical.LEAST_SCORE:
                accepted += 1
                retrieved += n in found
    assert accepted >= 250 and retrieved >= 0.99 * accepted


def test_all_near_entries_are_verified():
    ix = index([(k, f"Institute for Ceramics {a}{b}", None) for k, (a, b) in enumerate((a, b) for a in ("Nenso", "Dallo", "Gazam", "Denfu", "Luvam") for b in ("haven", "fjord", "minster", "ova", "burg", "thal"))])
    assert len(ix.candidates("institute ceramics")) == 30
    assert ix.best("Institute Ceramics") == {i: ix.score("institute ceramics", k) for k, (i, _) in enumerate(ix.entries) if ix.score("institute ceramics", k)}
