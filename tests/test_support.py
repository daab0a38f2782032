"""Gates of summaries on stated texts, and contradictions against all pairs."""

import random
import re

from pyspark.sql import functions as F

from newsloom.operators import support

SOURCE = "Mardi, la préfecture du Gard a évacué 1 200 habitants après trois jours de pluie. Le fleuve a dépassé 4,5 mètres à Nîmes."
#: summary of SOURCE, whether it is supported
SUMMARIES = [
    ("La préfecture du Gard a évacué 1200 habitants après plusieurs jours de pluie.", True),
    ("La préfecture du Gard a évacué 1300 habitants après plusieurs jours de pluie.", False),
    ("Mercredi, la préfecture du Gard a évacué des habitants après la pluie.", False),
    ("La préfecture du Gard et le maire de Montpellier ont évacué des habitants.", False),
    ("La préfecture a évacué des habitants pendant cinq jours de pluie.", False),
    ("La préfecture a évacué des habitants pendant 3 jours de pluie.", False),
    ("Trop court.", False),
    (None, False),
]
TITLE = "Le Gard évacue mille habitants menacés par la montée du fleuve"
#: summary, quality, reason, n_sentences
GATED = [
    ("Le Gard évacue mille habitants menacés par la montée du fleuve.", "rejected", "title-restatement", 0),
    ("La pluie tombe depuis samedi sur les vallées et les secours restent prêts. La pluie tombe depuis samedi sur les vallées, et les secours restent prêts ! Abonnez-vous à notre offre pour lire la suite.", "accepted", None, 1),
    ("Un texte court.", "rejected", "too-short-or-boilerplate", 0),
    ("Cet article parle de la pluie et du fleuve qui monte dans la vallée du Gard.", "rejected", "title-restatement", 0),
    ("Une pluie de cinq jours a eu lieu là, et il va bien pleuvoir ici.", "rejected", "low-information", 0),
    (None, "rejected", "too-short-or-boilerplate", 0),
]


def test_support(spark):
    df = spark.createDataFrame([(i, s, SOURCE) for i, (s, _) in enumerate(SUMMARIES)], "i int, s string, t string").select("i", support.supported(F.col("s"), F.col("t")).alias("y"))
    assert [r["y"] for r in sorted(df.collect())] == [y for _, y in SUMMARIES]


def test_support_with_title(spark):
    told = [("La préfecture du Gard a évacué 1200 habitants après plusieurs jours de pluie violente.", True), ("La préfecture du Gard a évacué 1300 habitants après plusieurs jours de pluie violente.", False), ("Mercredi, la préfecture a évacué des habitants menacés par la montée du fleuve à Nîmes.", True), ("La préfecture a évacué des habitants.", False), (None, False)]
    df = spark.createDataFrame([(i, s, SOURCE, TITLE) for i, (s, _) in enumerate(told)], "i int, s string, t string, h string").select("i", support.supported_with_title(F.col("s"), F.col("t"), F.col("h")).alias("y"))
    assert [r["y"] for r in sorted(df.collect())] == [y for _, y in told]


def test_gate(spark):
    df = spark.createDataFrame([(i, s, TITLE) for i, (s, *_) in enumerate(GATED)], "doc_id int, summary string, title string")
    got = sorted((r["doc_id"], r["quality"], r["reason"], r["n_sentences"]) for r in support.final_gate(df).collect())
    assert got == [(i, *rest) for i, (_, *rest) in enumerate(GATED)]


def test_corroboration(spark):
    one = lambda claims, texts: spark.range(1).select(support.corroborated(F.array(*map(F.lit, claims)), F.array(*map(F.lit, texts))).alias("y")).first()["y"]
    assert one(["12 morts"], ["12 morts ici", "il y a 12 morts", "rien"]) is True and one(["12 morts"], ["12 morts", "rien"]) is False


def test_contradictions_are_all_pairs(spark):
    texts = [("s", "A", "Le séisme du Japon a fait 12 morts dans la province centrale"), ("s", "B", "Le séisme du Japon a fait 15 morts dans la province centrale"), ("s", "A", "Le séisme du Japon a fait 15 morts dans la province centrale"), ("s", "C", "La bourse de Paris perd 3 points après la séance américaine"), ("t", "B", "Le séisme du Japon a fait 19 morts dans la province centrale"), ("s", "D", None)]
    found = support.numeric_contexts(spark.createDataFrame([(i, *r) for i, r in enumerate(texts)], "doc_id long, story string, source string, body string"), "story", "source", "body").collect()
    want = set()
    for a in found:
        for b in found:
            common = len(set(a["context"]) & set(b["context"]))
            if a["story"] == b["story"] and a["source"] != b["source"] and a["value"] != b["value"] and common >= 3 and common >= 0.52 * min(len(a["context"]), len(b["context"])):
                x, y = sorted([a, b], key=lambda r: (r["value"], r["source"]))
                want.add((a["story"], x["value"], y["value"], x["source"], y["source"]))
    contexts = spark.createDataFrame(found, "story string, source string, doc_id long, value string, context array<string>")
    got = {(r["story"], r["value_a"], r["value_b"], r["source_a"], r["source_b"]) for r in support.contradictions(contexts).collect()}
    assert got == want == {("s", "12", "15", "A", "B")}


def test_sentences_of_long_texts_equal_the_loop(spark):
    """Many sentences a text, repeated in whole, in part and in another order; texts don't touch one another."""
    r = random.Random(4)
    words = [f"parole{c}{d}" for c in "abcdef" for d in "xyz"]
    rows = []
    for k in range(6):
        said = [" ".join(r.sample(words, r.randrange(2, 12))) for _ in range(60)]
        said += [" ".join(sorted(s.split())) + r.choice(["", " bis", " encore nouveau"]) for s in r.sample(said, 30)] + ["Abonnez-vous à notre newsletter ici", "court"]
        r.shuffle(said)
        rows.append((k, ". ".join(said) + "."))
    got = {x["doc_id"]: x["kept"] for x in support.distinct_sentences(spark.createDataFrame(rows, "doc_id int, summary string")).collect()}
    for k, body in rows:
        kept = []
        for s in (p.strip() + "." for p in body.split(".") if p.strip()):
            t = {w for w in re.sub("[^a-z0-9]+", " ", s.lower()).split() if len(w) >= 4}
            if len(s) < 18 or s.startswith("Abonnez") or any(len(t & o) >= 0.9 * min(len(t), len(o)) or a == s for a, o in kept):
                continue
            kept.append((s, t))
        assert got[k] == [s for s, _ in kept] and len(kept) < 85


def test_contexts_of_a_long_text(spark):
    """A number takes six parts on either side along, wherever it stands."""
    body = " ".join(f"mot{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}xx {k}" for k in range(990))
    got = support.numeric_contexts(spark.createDataFrame([(1, "s", "A", body)], "doc_id int, story string, source string, body string"), "story", "source", "body")
    rows = {r["value"]: r["context"] for r in got.collect()}
    assert len(rows) > 980 and all(3 <= len(c) <= 7 for c in rows.values())


def test_shares_are_exact(spark):
    """7 of 25 words are 28 %, though 0.28 * 25 is more than 7 in binary."""
    words = [f"parole{chr(97 + k)}" for k in range(25)]
    row = spark.createDataFrame([(" ".join(words), " ".join(words[:7]), " ".join(words[:6]))], "a string, b string, c string")
    assert row.select(support.token_share_supported(F.col("a"), F.col("b")), support.token_share_supported(F.col("a"), F.col("c"))).first()[:] == (True, False)


def test_contexts_meet_as_hubs(spark):
    """Values and sources are gathered before they meet: no pair of contexts is compared in the join that gives the rows."""
    rows = [("s", f"src{k % 3}", k, str(k % 2), ["japon", "morts", "province", f"mot{k}"]) for k in range(40)]
    got = support.contradictions(spark.createDataFrame(rows, "story string, source string, doc_id long, value string, context array<string>"))
    assert "array_intersect" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for _, s, i, v, _ in rows:
        for _, t, j, w, _ in rows:
            if s != t and v < w:
                a, b = want.get((v, w, s, t), (i, j))
                want[v, w, s, t] = (min(a, i), min(b, j))
    assert {(r["value_a"], r["value_b"], r["source_a"], r["source_b"]): (r["id_a"], r["id_b"]) for r in got.collect()} == want


def test_gate_shuffles_and_writes_nothing(spark, monkeypatch):
    """A text is one row: its sentences are judged there, whatever their number."""
    written = []
    monkeypatch.setattr(support, "cut", lambda df: written.append(df) or df)
    gated = support.final_gate(spark.createDataFrame([(i, s, TITLE) for i, (s, *_) in enumerate(GATED)], "doc_id int, summary string, title string"))
    assert not written and "Exchange" not in gated._jdf.queryExecution().executedPlan().toString()


def test_boilerplate_is_found_by_its_parts(spark):
    told = "Pour lire cet article|Partager la publication|Se connecter|Identifiez-vous|Connexion à votre compte|Créez un compte|Déjà abonné|Nos offres|La newsletter|Recevez nos actualités|Inscrivez-vous à|Gestion des cookies|Préférences de confidentialité|Votre consentement|Notification pour ne rien manquer|Partager sur|Suivez-nous|Retrouvez nous sur|Voir aussi|À découvrir|Sur le même sujet|Ajouter l’article dans mes favoris|Ouvrez l’article|Consultez les détails|R&#233;sumé indisponible"
    plain = "Les offres d’emploi|Il va aussi partager|Un compte rendu|Une notification"
    of = lambda x: [r["y"] for r in sorted(spark.createDataFrame(list(enumerate(x.split("|"))), "i int, s string").select("i", support.is_boilerplate(F.col("s")).alias("y")).collect())]
    assert all(of(told)) and not any(of(plain))


def test_kept_places_equal_the_loop():
    r = random.Random(7)
    for most in (6, 14, 24, 60):
        words = [f"mot{k:02}" for k in range(most)] + ["avec", "un"]
        said = [" ".join(r.choices(words, k=r.randrange(1, 14))) for _ in range(150)] + ["un", "la", "un", "avec"]
        kept = []
        for k, key in enumerate(said):
            own = {w for w in key.split() if len(w) >= 4 and w != "avec"}
            if not any(said[j] == key or o and own and 10 * len(own & o) >= 9 * min(len(own), len(o)) for j, o in kept):
                kept.append((k, own))
        assert support.kept_places("\n".join(said)) == [k for k, _ in kept]
    assert support.kept_places("") == []
