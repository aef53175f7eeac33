"""Subjects, official matches and product groups on small tables with known answers."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from lonja.llm.encoder import Encoder, kmeans, tune_probes
from lonja.llm.listing_attributes import deletions
from lonja.llm.official_match import exclusive, fit_mixture, match_official, posteriors
from lonja.llm.product_groups import compatible, components, product_groups, product_links, product_pairs
from lonja.llm import subjects
from lonja.llm.subjects import document_subjects, sentences
from lonja.llm.vehicle_text import Lexicon, fold, model_likeness, read
from tests.test_units_snapshots import T0, reference


def test_sentences():
    assert sentences("<p>¿Vale la pena? Depende. El par&nbsp;motor 12 sube.</p>\nFin.") == [["vale", "la", "pena"], ["el", "par", "motor", "9", "sube"], ["fin"]] and sentences(None) == [] and sentences("<br/>") == []


def test_subjects_held_out(spark):
    r = random.Random(2)
    nouns = {1: ["the withholding", "the customs form", "the levy"], 2: ["the piston ring", "the flywheel", "the injector"], 0: ["the colour", "the weather", "the office"]}
    say = ["many readers ask about {}", "over the last year {} moved by 9 per cent", "{} is often underrated", "it all came down to {}"]
    docs, labels, truth = [], [], {}
    for i in range(400):
        own = r.choice([(1,), (2,), (1, 2), ()])
        text = ". ".join(r.choice(say).format(r.choice(nouns[r.choice(own or (0,))])) for _ in range(10)) + "."
        docs.append((i, text, "x"))
        truth[i] = set(own)
        if i < 200:
            labels += [(i, s) for s in own or (0,)]
    df = spark.createDataFrame(docs + [(900, None, "x"), (901, "", "x"), (902, "<p></p>", "x")], "doc_id long, text string, share string")
    lab = spark.createDataFrame(labels, "doc_id long, subject_id int")
    got = {(x.doc_id, x.subject_id) for x in document_subjects(df, lab).collect() if x.doc_id >= 200}
    want = {(i, s) for i in range(200, 400) for s in truth[i]}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)
    assert document_subjects(df.limit(0), lab).count() == 0 and document_subjects(df, lab.limit(0)).count() >= 0


LEX = Lexicon({"dtr": "diesel", "ecojet": "gasoline"}, ("terranova", "urbanis"), {})


def test_reading():
    r = read("Sørby Kalbaya 2,2l DTR 211 PS Aut. Terra. Paket L63N6", LEX)
    assert (r.litres, r.drive, r.gear, r.trim) == (2.2, "dtr", "automatic", "terranova") and abs(r.kw - 155.2) < 0.1 and model_likeness(r.rest, "kalbaya") == 1.0
    assert model_likeness(["kallilis", "iii"], "kallilis iii") == 1.0 > model_likeness(["kallilis", "iii"], "kallilis") and fold("ＳØＲBY Ⅲ") == "sorby iii"
    assert read(None, LEX).trim is None and set(deletions("abcd")) & set(deletions("abdc"))


def test_posteriors_share_one_unit():
    p = exclusive(np.array([8.0, 7.0, -5.0]))
    assert p.sum() < 1 and p[0] > p[1] > p[2] and exclusive(np.array([])).size == 0


def test_match_official(spark):
    models, trims, drives = ["Kalbaya", "Vazon", "Ormam II"], ["Terranova", "Urbanis", "Prestige", "Lineal", "Klassik"], [("2.2", "DTR", "D", 2195, 155), ("1.4", "EcoJet", "G", 1399, 85)]
    brands = [(i, "make", n) for i, n in enumerate(["Alfano", "Borsalo", "Cermat", "Doveno"], 1)]
    off, n = [], itertools.count(1)
    for _, _, b in brands:
        for m, t, (lit, d, f, cc, kw), g in itertools.product(models, trims, drives, ("", " Aut.")):
            off.append((next(n), 1, "turismo", b.upper(), f"{m} {lit} {d} {t}{g}", 2010, 2020, cc, 4, f, kw, 10.0, 100, 20000))
    schema = "id long, dataset_id long, category string, brand string, model_type string, commercial_start int, commercial_end int, displacement_cc int, cylinders int, fuel_code string, power_kw int, fiscal_hp double, power_cv int, value_eur int"
    official = spark.createDataFrame(off, schema)
    canon = spark.createDataFrame(brands, "canon_id long, list_name string, canon_value string")
    r, veh, want = random.Random(4), [], set()
    import datetime as dt
    for i in range(240):
        o = r.choice(off)
        words = o[4].replace("Aut.", "automático").replace("Terranova", r.choice(["Terranova", "Terra.", "Terranva"])).split(" ")
        year = r.choice([2012, 2019, 2019, 2005])
        veh.append((i, o[3].title(), " ".join(words), dt.date(year, 3, 1), {"D": "gasoil", "G": "Gasolina"}[o[9]], r.choice([o[7], o[7] + 3, None]), r.choice([float(o[10]), o[10] + 1.0, None])))
        if year >= 2010:
            want.add((i, o[0]))
    veh += [(900, None, None, None, None, None, None), (901, "Alfano", "Kalbaya 9.9 DTR Terranova", dt.date(2015, 1, 1), "D", 9900, 400.0), (902, "Zzz", "Kalbaya", dt.date(2015, 1, 1), "D", 1, 1.0)]
    v = spark.createDataFrame(veh, "vehiculo_id long, marca string, modelo string, fecha_primera_matriculacion date, combustible string, cilindrada_cc int, potencia_kw double")
    got = {(x.vehiculo_id, x.boe_id) for x in match_official(v, official, canon).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.97 * len(got) and not {i for i, _ in got} & {900, 901, 902}
    assert match_official(v.limit(0), official, canon).count() == 0


def test_the_mixture_decides_where_the_sum_of_likenesses_errs(spark):
    """Displacement varies alike in matched and unmatched pairs, power does not: without labels the mixture learns to weigh power."""
    rng, clip = np.random.default_rng(2), lambda v: [float(min(1.0, max(0.0, x))) for x in v]
    match = lambda: clip([rng.normal(0.97, 0.02), rng.normal(0.97, 0.02), rng.normal(0.97, 0.02), rng.uniform(0.3, 1.0), rng.normal(0.97, 0.01), 1.0])
    other = lambda: clip([rng.normal(0.9, 0.05), rng.normal(0.85, 0.1), rng.normal(0.8, 0.1), rng.uniform(0.3, 1.0), rng.normal(0.75, 0.05), 1.0])
    rows = [(v, [{"boe_id": 10 * v, "x": match()}] + [{"boe_id": 10 * v + i, "x": other()} for i in range(1, 4)]) for v in range(300)]
    a, b = [0.96, 0.96, 0.96, 0.35, 0.97, 1.0], [0.93, 0.95, 0.92, 1.0, 0.80, 1.0]
    rows.append((999, [{"boe_id": 1, "x": a}, {"boe_id": 2, "x": b}]))
    cands = spark.createDataFrame(rows, "vk long, cands array<struct<boe_id:long,x:array<double>>>")
    post = {(r.vk, r.boe_id): r.posterior for r in posteriors(cands, fit_mixture(cands)).collect()}
    assert sum(a) < sum(b) and post[999, 1] > 0.9 > post[999, 2]
    assert np.mean([post[v, 10 * v] > 0.5 for v in range(300)]) > 0.95


def test_encoder_learns_and_index_recalls():
    r = random.Random(1)
    prods = [f"model{i % 20} drive{i % 3} trim{i % 5} pack{i}x" for i in range(150)]
    noise = [f"word{j}" for j in range(12)]
    texts = [(p, " ".join(r.sample(p.split() + r.sample(noise, 4), 8))) for p in prods for _ in range(3)]
    enc = Encoder()
    enc.weigh([t for _, t in texts])
    pairs = [(a[1], b[1]) for a, b in itertools.pairwise(texts) if a[0] == b[0]]
    losses = enc.train(pairs, steps=60)
    x = enc.encode([t for _, t in texts])
    s = x @ x.T - 9 * np.eye(len(x))
    assert losses[-1] < losses[0] and np.mean([texts[i][0] == texts[j][0] for i, j in enumerate(s.argmax(1))]) > 0.95
    probes, found = tune_probes(x, kmeans(x, 12), 5, 0.95)
    assert found >= 0.9 and probes <= 12 and enc.encode([]).shape[0] == 0


def test_components(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7)], "lo long, hi long")
    got = {r.node: r.group for r in components(df).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[102] == 100 and components(df.limit(0)).count() == 0


def test_vetoes():
    a = np.array([1, 1, 1, 1, 1, 1, 2195, 22, 155])  # unknown is below zero
    ch = lambda **k: np.array([k.get(f"c{i}", v) for i, v in enumerate(a)])
    assert compatible(a, ch(c5=-1, c6=-1, c8=156)) and not compatible(a, ch(c8=158)) and not compatible(a, ch(c2=3)) and compatible(a, ch(c2=-1)) and not compatible(a, ch(c5=3))


def test_products(spark):
    r, rows, truth = random.Random(9), [], {}
    noise = ["TOP Zustand", "oferta", "★★★", "único dueño", "LED", "AHK"]
    i = itertools.count(1)
    for k in range(60):
        m, t, d, kw, cc, g, p = f"Modelo{'abcdefghij'[k % 10]}", ["Terranova", "Urbanis", "Lineal"][k % 3], [("DTR", "diesel"), ("EcoJet", "gasoline")][k % 2], 70 + k, 1500 + 10 * k, ["manual", "automatic"][k % 2], f"{'ABCDEF'[k % 6]}{10 + k}B{k % 10}"
        for _ in range(4):
            bits = [m, f"{cc}cc {d[0]}", t, f"Paket {p}", {"manual": "Schaltgetriebe", "automatic": "Aut."}[g], f"{kw} kW", *r.sample(noise, 2)]
            r.shuffle(bits)
            rid = next(i)
            rows.append((rid, "s", T0, " ".join(bits), m, cc if r.random() < 0.8 else None, kw, None, None, 1.0, None, None, None, "DE", "x", f"{d[0]} {t}", g if r.random() < 0.9 else None, d[1]))
            truth.setdefault(k, []).append(rid)
    rows += [(900, "s", T0, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None), (901, "s", T0, "", "", None, None, None, None, None, None, None, None, None, None, "", None, None), rows[0][:0] + (902, *rows[0][1:])]
    schema = "row_id long, source string, scraped_at timestamp, title string, model string, engine_displacement_cc int, power_kw int, power_hp int, power_raw string, price_eur double, price_net_eur double, original_price double, price_raw string, country_code string, rep string, version string, transmission string, fuel_type string"
    df = spark.createDataFrame(rows, schema)
    truth[0].append(902)
    groups = product_groups(df, *reference(spark))[0].cache()
    got = {(x.row_id_a, x.row_id_b) for x in product_pairs(groups).collect()}
    links = {x.row_id: x.links for x in product_links(groups).collect()}
    assert all(links[i] == sum(i in pair for pair in got) for i in links) and groups.count() == len(rows)
    want = {(a, b) for v in truth.values() for a, b in itertools.combinations(sorted(v), 2)}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.99 * len(got)
    assert product_pairs(product_groups(df.limit(0), *reference(spark))[0]).count() == 0


def test_the_fit_takes_all_labelled_texts(spark, monkeypatch):
    many = spark.range(10_500).select(F.col("id").alias("doc_id"), F.lit(1).alias("subject_id"))
    assert subjects.labelled_ids(many).count() == 10_500
    texts = [(i, f"the {'piston' if i % 2 else 'levy'} ring number{i % 7} of house{i % 3}", [1 + i % 2]) for i in range(60)]
    sample = spark.createDataFrame(texts, "doc_id long, text string, subjects array<int>")
    whole = subjects.fit_terms(sample)
    monkeypatch.setattr(subjects, "HELD", 10)
    assert subjects.fit_terms(sample) == whole and "piston" in whole and set(whole["piston"]) == {2}
