import itertools
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import encoding, pii, stuffing, tokens

GIVEN = [f"{a}{b}" for a in "Ba Cor Dal Fen Gar Hal Jor Mar".split() for b in ("ndo", "wyn")]
FAMILY = [f"{a}{b}" for a in "Ba Cor Dal Fen Gar Hal Jor Mar Nor Pel".split() for b in ("sgaard", "quist")]


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(GIVEN, FAMILY)


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("Write to bandosgaard+lists@mail.x.example for it.", [("email", "bandosgaardlistsmailxexample")]),
        ("<me.too [at] mail [dot] x [dot] test>", [("email", "metooatmaildotxdottest")]),
        ("reach me.too at mail dot x dot test now", [("email", "metooatmaildotxdottest")]),
        ("mail A.B @ Post.X.Invalid please", [("email", "abpostxinvalid")]),
        ("Follow @some_desk. Sold 52 @ 30.90 each.", []),
        ("Call +1 496 555 0164 ext. 9 after six", [("phone", "14965550164")]),
        ("ring 07700 900330 twice or (497)555 0172", [("phone", "07700900330"), ("phone", "4975550172")]),
        ("Fax/phone 335 / 555 / 0108.", [("phone", "3355550108")]),
        ("epoch 1780972893, offset 969908; build 4.58.120.8787", []),
        ("The shelf holds 795 290 926 grains.", []),
        ("SSN 914-99-0824 was printed", [("id_number", "914990824")]),
        ("tax id QQ 72 99 56 D and national id 39799326-Z", [("id_number", "39799326z"), ("id_number", "qq729956d")]),
        ("Lot 854-38-5926-Y failed; Ticket #859791010", []),
        ("I live at 782 S Torcombe Way, flat 10.", [("street_address", "782storcombeway")]),
        ("ship_to 706 kelkellen rd, Velsastead", [("street_address", "706kelkellenrd")]),
        ("deliver to Garvacombeweg 207 or 37 rue Norpelsley", [("street_address", "37ruenorpelsley"), ("street_address", "garvacombeweg207")]),
        ("Zovarick Street stays closed. 4 lanes and 20 roads were resurfaced.", []),
        ("Please thank Mr. Basgaard and J. K. Dalquist.", [("person_name", "basgaard"), ("person_name", "jkdalquist")]),
        ("signed by FENQUIST, Corwyn", [("person_name", "fenquistcorwyn")]),
        ("My name is Reed Tolsgaard-Marquist and so on", [("person_name", "reedtolsgaardmarquist")]),
        ("contact: bandondo sgaard; the sgaards", []),
        ("My number: 415-867-5309 or 1-212-736-5000", [("phone", "12127365000"), ("phone", "4158675309")]),
        ("call 867-5309 at noon; pages 867-5309", [("phone", "8675309")]),
        ("phone (212) 736 5000, rows 415 867 5309", [("phone", "2127365000")]),
        ("pii: 412-34-5678", [("id_number", "412345678")]),
        ("Thanks to Dr. Patel and Prof. Ama Lindqvist-Okafor.", [("person_name", "patel"), ("person_name", "amalindqvistokafor")]),
        ("Dear Mrs. J. R. Okafor, Mr Chairman and madam speaker", [("person_name", "jrokafor")]),
        ("We moved to 12 Elm Dr. Monday was fine.", [("street_address", "12elmdr")]),
        ("jane ( at ) x.example, a at b{dot}example, meet at noon", [("email", "aatbdotexample"), ("email", "janeatxexample")]),
        ("ＡＢ@x.example ＋ 1", [("email", "ａｂxexample")]),
        ("", []),
    ],
)
def test_items(finder, text, items):
    assert finder.items(text) == sorted(items)


def test_redaction_keeps_the_rest(finder):
    assert finder.redact("Ask Corwyn Dalquist (a@b.example) today.") == "Ask [PERSON_NAME] ([EMAIL]) today."
    long = "nothing here " * 50_000 + "a@b.example"
    assert finder.redact(long).endswith("here [EMAIL]")


def test_pii_frames(spark):
    names = spark.createDataFrame([(n, "family") for n in FAMILY] + [(n, "given") for n in GIVEN] + [(None, "given")], "name string, kind string")
    recs = spark.createDataFrame([("1", "mail a@b.example"), ("1", "mail a@b.example"), ("2", None), (None, "x@y.example")], "id string, text string")
    gates = spark.createDataFrame([("g", {"no_pii: saw tel +44 7700 900 118": 1}), ("h", None)], "gate_run_id string, reasons_histogram map<string,long>")
    texts = pii.texts_of(recs, gates)
    got = {tuple(r) for r in pii.find_items(texts, names).collect()}
    assert got == {("synth_records", "1", "email", "abexample"), ("gate_results", "g", "phone", "447700900118")}
    clean = sorted(tuple(r) for r in pii.redact(texts, names).collect())
    assert clean == [("gate_results", "g", "no_pii: saw tel [PHONE]"), ("synth_records", "1", "mail [EMAIL]"), ("synth_records", "2", "")]
    assert pii.find_items(texts.limit(0), names).count() == pii.redact(texts.limit(0), names.limit(0)).count() == 0


def test_a_long_name_list_is_joined_instead_of_held(spark):
    names = spark.createDataFrame([(n, "family") for n in FAMILY] + [(n, "given") for n in GIVEN] + [("Okafor", "family")], "name string, kind string")
    texts = ["Ask Corwyn Dalquist or Corwyn Okafor.", "by J. K. Okafor and Reed Tolsgaard", "", "Okafor, Corwyn; mail a@b.example"]
    rows = spark.createDataFrame([("synth_records", str(i), t) for i, t in enumerate(texts * 2)], "origin string, rec_key string, text string")
    held, joined = ({tuple(r) for r in pii.find_items(rows, names, most).collect()} for most in (1000, 3))
    assert held == joined and len(held) == 12


CLEAN = {
    "es": ["La canción cambió hace {} años.", "Mañana la cañada llegará a {} vecinos.", "¿Por qué creció la montaña {}?"],
    "de": ["Für die Brücke zahlt die Stadt {} Kronen mehr.", "Während die Fähre gelöscht war, fuhr keine Straße {}.", "Über {} Gäste hörten es später."],
    "ru": ["Новая школа была закрыта через {} дней.", "Почему дорога {} снова закрыта, никто не знает.", "Около {} жителей видели башню."],
    "el": ["Η νέα πόλη άλλαξε μετά από {} μέρες.", "Σχεδόν {} άνθρωποι είδαν την παλιά γέφυρα.", "Γιατί έκλεισε η θάλασσα {} τόσο νωρίς;"],
}


@pytest.fixture(scope="module")
def repairer():
    counts: Counter = Counter()
    for i in range(60):
        for forms in CLEAN.values():
            for f in forms:
                counts.update(encoding._trigrams(f.format(i)))
    return encoding.Repairer(encoding.Model.of(counts))


def test_held_out_clean_text_is_left_alone(repairer):
    texts = [f.format(900 + i) for i in range(5) for forms in CLEAN.values() for f in forms]
    texts += ["├── rows  └── index", "[████░░░░] 50 %", "Ñandú, übrig, Œuvre", "“yes” … ‘no’ • maybe™", "x² + y³ ÷ 2", "NÃO há pão", "plain ascii", ""]
    for t in texts:
        assert repairer.text(t) == (False, t, False), t


def test_held_out_garbled_text_is_restored(repairer):
    n = good = 0
    for lang, forms in CLEAN.items():
        for page in ("cp1252", "latin-1", "cp437", "cp850", "mac-roman", "cp1251", "cp1250"):
            table, _ = encoding._code_page(page)
            for f in forms:
                clean = f.format(777)
                garbled = "".join(table[b] for b in clean.encode())
                if garbled == clean:
                    continue
                bad, read, lost = repairer.text("An English line. " + garbled + "\nAnother one.")
                n += 1
                assert bad, (lang, page, garbled)
                good += read == "An English line. " + clean + "\nAnother one."
    assert good / n > 0.95, (good, n)
    twice = "".join(encoding._code_page("cp1252")[0][b] for b in "".join(encoding._code_page("cp1252")[0][b] for b in CLEAN["es"][0].encode()).encode())
    assert repairer.text(twice)[1] == CLEAN["es"][0]
    koi = CLEAN["ru"][1].format(5).encode("koi8-r").decode("cp1251")
    assert repairer.text(koi) == (True, CLEAN["ru"][1].format(5), False)
    assert repairer.text("La canci�n") == (True, "La canci�n", True)


def test_margins_are_validated_on_clean_passages(repairer):
    clean = [f.format(i) for i in range(40) for forms in CLEAN.values() for f in forms]
    report = encoding.validate(repairer.model, clean)
    assert report["passages"] > 400 and report["margin_utf8"] == encoding.MARGIN_UTF8 and report["margin_single"] >= encoding.MARGIN_SINGLE
    assert report["restored_utf8"] > 0.97 and report["restored_single"] > 0.8
    assert encoding.validate(repairer.model, [])["margin_single"] == encoding.MARGIN_SINGLE


def test_every_reading_of_a_level_is_scored():
    """Texts that decode through more code pages than any fixed number of readings."""
    chains = encoding.Chains()
    clean = "Für die Brücke über die Straße"
    for page in encoding.WRONG:
        garbled = "".join(encoding._code_page(page)[0][b] for b in clean.encode())
        assert clean in chains.deep(garbled), page


def test_garbled_frames(spark):
    rows = [(str(i), f.format(i)) for i in range(20) for forms in CLEAN.values() for f in forms]
    rows = [(f"{i}-{k}", t) for k, (i, t) in enumerate(rows)]
    bad = [("b1", rows[0][1].encode().decode("latin-1")), ("b2", "a�b"), ("b1", rows[0][1].encode().decode("latin-1")), (None, "Ã©Ã©"), ("n", None), ("e", "")]
    got = {r.id: (r.restored, r.lost) for r in encoding.find_garbled(spark.createDataFrame(rows + bad, "id string, text string")).collect()}
    assert got == {"b1": (rows[0][1], False), "b2": (None, True)}
    assert encoding.find_garbled(spark.createDataFrame([], "id string, text string")).count() == 0


def page_samples(n, seed):
    rng = random.Random(seed)
    nouns, verbs = "harbour market bridge garden school river council farmer".split(), "opened closed praised moved counted repaired".split()
    sentence = lambda: f"The {rng.choice(nouns)} near the {rng.choice(nouns)} was {rng.choice(verbs)} after {rng.randrange(99)} days because of the {rng.choice(nouns)}."
    code = lambda: f"def {rng.choice(verbs)}_{rng.choice(nouns)}(x):\n    return x + {rng.randrange(99)}  # never {rng.choice(verbs)}"
    table = lambda: f"{rng.choice(nouns).title()}  {rng.randrange(24)}.{rng.randrange(10, 60)}  {rng.randrange(24)}.{rng.randrange(10, 60)}"
    words = "cheap best buy sale discount online review free shipping coupon outlet".split()
    thing = lambda: rng.choice(("red kettle", "garden hose", "oak desk"))
    tag = lambda key: f"{key} {rng.choice(words)}, {rng.choice(words)} {key}, {key}"
    link = lambda: f"[{rng.choice(words)} {thing()}](https://{rng.choice(nouns)}{rng.randrange(99)}.example/p?id={rng.randrange(99)})"
    out = []
    for i in range(n):
        kind = i % 5
        if kind == 0:
            out.append((" ".join(sentence() for _ in range(9)), False))
        elif kind == 1:
            out.append(("\n".join(code() for _ in range(8)), False))
        elif kind == 2:
            out.append(("Line timetable, valid from spring.\n" + "\n".join(table() for _ in range(12)), False))
        elif kind == 3:
            key = thing()
            out.append((sentence() + "\n" + "\n".join(tag(key) for _ in range(14)), True))
        else:
            out.append(("\n".join(link() for _ in range(14)) + "\n" + sentence(), True))
    out += [(" ".join(sentence() for _ in range(9)) + "\nTags: bridge, market", False)] * 3
    return out


def shares_of(model, texts):
    return model.shares(stuffing.Reader()(texts)).tolist()


def test_stuffed_pages_on_held_out_pages(spark):
    rows = [(i, t) for i, (t, _) in enumerate(page_samples(600, 1))]
    model = stuffing.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    held = page_samples(200, 2)
    wrong = [(t[:60], s) for (t, bad), s in zip(held, shares_of(model, [t for t, _ in held])) if (s > 0.5) != bad]
    assert len(wrong) <= 4, wrong[:5]
    assert shares_of(model, ["", " \n\n"]) == [0.0, 0.0]
    rows = [(i, t) for i, (t, _) in enumerate(page_samples(150, 3))] + [(900, None), (901, ""), (None, "x"), (0, page_samples(150, 3)[0][0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in stuffing.stuffed_pages(df).collect()}
    want = {i for i, (_, bad) in enumerate(page_samples(150, 3)) if bad}
    assert len(got ^ want) <= 4
    assert stuffing.stuffed_pages(df.limit(0)).count() == 0


def test_rare_list_states_are_not_left_out(spark):
    """One page of links, one of tags and one menu among many pages of prose, code and tables, and not all in the sample."""
    links = "\n".join(f"[cheap hose {i}](https://shop{i}.example/p?id={i})" for i in range(14))
    tags = "\n".join("#hose #cheap #hosepipe #sale" for _ in range(8))
    menu = "\n".join("Home | About | Contact | Login" for _ in range(8))
    plain = [t for t, bad in page_samples(400, 4) if not bad]
    rows = list(enumerate([links, tags, menu, *plain]))
    got = {r.doc_id for r in stuffing.stuffed_pages(spark.createDataFrame(rows, "doc_id long, text string"), training_pages=60).collect()}
    assert got == {0, 1, 2}


def test_lines_and_their_features():
    read = stuffing.Reader()
    lines = read(["Tags: oak desk, oak-desk\n\n1. first step 30 40\n<a href='https://x.example/y'>Oak desks</a> see www.x.test/a\nx = f(y)", "", "Wait! " * 60])
    assert lines.pages == 3 and lines.page.tolist() == [0, 0, 0, 0] + [2] * 60
    assert lines.size[:4].tolist() == [4, 5, 5, 3] and lines.size[4:].tolist() == [1] * 60
    assert lines.meta[:4].tolist() == [True, False, False, False] and lines.lead[:4].tolist() == [False, True, False, False]
    assert lines.links[:4].tolist() == [0, 0, 0.8, 0] and lines.code[:4].tolist() == [False, False, False, True]
    assert lines.digits[1] == 0.6 and lines.seps[0] == 0.25
    assert len(set(read(["oak-desk OakDesk oakdesks oak’desk"]).hash.tolist())) == 1 and len(set(read(["ab ba a b"]).hash.tolist())) == 4
    assert len(read(["word " * 200]).page) == 7  # no sentence ends: pieces of 30 words


def test_paths_equal_brute_force():
    rng = np.random.default_rng(3)
    k = len(stuffing.STATES)
    tables = [t / t.sum(0) for t in (rng.random((w, k)) + 0.1 for w in stuffing.WIDTHS)]
    move = rng.random((k, k)) + 0.05
    model = stuffing.Model(np.zeros(0, np.uint64), np.zeros(stuffing.BUCKETS, np.float32), tables, np.full(k, 1 / k), move / move.sum(1, keepdims=True))
    page = np.repeat([0, 2, 3, 7], [1, 4, 3, 5])
    seen = np.column_stack([rng.integers(0, w, len(page)) for w in stuffing.WIDTHS])
    got = model.paths(seen, page)
    emit = sum(w * np.log(t)[f] for w, t, f in zip(stuffing.WEIGHTS, model.tables, seen.T))
    for p in set(page.tolist()):
        e = emit[page == p]
        worth = lambda path: np.log(model.start[path[0]]) + sum(e[i][s] for i, s in enumerate(path)) + sum(np.log(model.move[a, b]) for a, b in zip(path, path[1:]))
        assert tuple(got[page == p].tolist()) == max(itertools.product(range(k), repeat=len(e)), key=worth)


def test_token_counts_match_the_tokenizer(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "héllo <|endoftext|> " * 3)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in tokens.count_tokens(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 10
    assert tokens.count_tokens(df.limit(0), "doc_id", "text").count() == 0


def test_single_byte_gains_in_arrays(repairer):
    import numpy as np

    rng = np.random.default_rng(3)
    signs = rng.integers(1, 0x10FFFF, (3, 500)).astype(np.uint64)
    signs = signs[:, ((signs < 0xD800) | (signs > 0xDFFF)).all(0)]
    assert encoding._buckets(*signs).tolist() == [encoding._bucket("".join(map(chr, t))) for t in signs.T.tolist()]
    model, chains = repairer.model, repairer.chains
    for forms in CLEAN.values():
        for text in [forms[0].format(3), "x " + forms[0].format(5).upper(), forms[0].format(4).encode("utf-8").decode("cp1251", "replace")]:
            if held := chains.to_single(text):
                want = max(0.0, encoding._gain(model, text, held)[0])
                assert abs(encoding._single_gain(model, chains, text, model.score(text)) - want) < 1e-4


def test_margins_rest_on_all_passages(spark):
    """One record of 3,001 holds the only clean passage that a single-byte chain makes likelier."""
    text = CLEAN["ru"][0].format("")
    other = text.encode("koi8-r").decode("cp1251")
    rows = [(f"t{i}", text) for i in range(3000)] + [("one", "\n".join([other] * 40))]
    report = {r.measure: r.value for r in encoding.margins(spark.createDataFrame(rows, "id string, text string").repartition(4)).collect()}
    assert report["margin_single"] > encoding.MARGIN_SINGLE and report["passages"] > 3000
    df = spark.createDataFrame(rows, "id string, text string").repartition(4)
    assert encoding.find_garbled(df).count() == 0


def test_frequent_words_are_those_that_fill_their_page():
    import numpy as np

    texts = ["Red shoes, red hats, red bags and 17 17 17 red coats. The end of it all.", "", "one two three four five", "Blue car blue car blue car of of of of"]
    lines = stuffing.Reader()(texts)
    telling = (lines.letters > 2) & ~lines.numeric
    of = lines.page[lines.line]
    pairs = list(zip(of.tolist(), lines.hash.tolist()))
    want = [pairs.count(p) >= max(3, 0.07 * (of == p[0]).sum()) for p in pairs]
    assert lines.frequent[telling].tolist() == np.array(want)[telling].tolist() and lines.frequent.sum() == 10
    assert not stuffing.Reader(repeats=False)(texts).frequent.any()
