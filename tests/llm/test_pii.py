import itertools
import random

from lodestrand.llm import pii


def path_score(field, cand, n_toks, entities):
    """Score of the segmentation that has these (first, tokens, type) and is outside elsewhere."""
    starts, at, before, total = {i: (n, k) for i, n, k in entities}, 0, pii.OUT, 0.0
    while at < n_toks:
        n, k = starts.get(at, (1, pii.OUT))
        total += field.weights.get((before, k), 0.0)
        if k != pii.OUT:
            total += sum(field.weights.get((k, f), 0.0) for f in dict(cand[at + n])[n])
        at, before = at + n, k
    return total


def all_segmentations(cand, n_toks, i=0):
    """Every segmentation, as its entities."""
    if i == n_toks:
        yield ()
        return
    yield from all_segmentations(cand, n_toks, i + 1)
    for j in range(i + 1, n_toks + 1):
        for n, _ in cand[j]:
            if j - n == i:
                for k in range(len(pii.TYPES)):
                    for rest in all_segmentations(cand, n_toks, j):
                        yield ((i, n, k), *rest)


def loose(r):
    """A field of random weights, in which transitions count for much."""
    return pii.Field({(k, f): r.uniform(-2, 2) for k in range(len(pii.TYPES)) for f in ["any", *pii.SHAPES, "luhn", "joined_left"]} | {(a, b): r.uniform(-2, 2) for a in range(pii.OUT + 1) for b in range(pii.OUT + 1)})


def test_program_finds_the_best_of_all_segmentations():
    r = random.Random(3)
    field, mine = pii.train(), loose(r)
    for text, _ in pii.sentences(60, seed=9):
        for a, b in pii.islands(text):
            toks = pii.tokens(text, a, b)[:9]
            cand = pii.segments(text, toks)
            for f in (field, mine):
                want = max(path_score(f, cand, len(toks), x) for x in all_segmentations(cand, len(toks)))
                got = pii.decode(f, text, toks)
                assert abs(path_score(f, cand, len(toks), got) - want) < 1e-9
                assert all(i + n <= j for (i, n, _), (j, _, _) in itertools.pairwise(got))


def test_transitions_decide():
    text = "10.2.3.4 10.2.3.5"
    toks = pii.tokens(text, 0, len(text))
    alike = {(k, "any"): -9.0 for k in range(pii.OUT)} | {(3, "ip"): 1.0, (3, "any"): -0.5}
    got = lambda w: [k for _, _, k in pii.decode(pii.Field(alike | w), text, toks)]
    assert got({}) == [3, 3] and got({(3, 3): -0.9}) == [3] and got({(3, 3): -9.0, (pii.OUT, 3): -1.0}) == []


def test_gradient_against_all_segmentations():
    r = random.Random(5)
    field = loose(r)
    text = "mail a.b@c.de 10.2.3.4 now"
    toks = pii.tokens(text, 0, len(text))
    cand = pii.segments(text, toks)
    gold = [(toks.index((5, 6)), 7, 0), (toks.index((14, 16)), 7, 3)]

    def likelihood(f):
        scores = [path_score(f, cand, len(toks), x) for x in all_segmentations(cand, len(toks))]
        assert abs(pii._lse(scores) - pii._lse(list(pii.forward(pii.edges_of(f, cand, len(toks)), len(toks))[-1].values()))) < 1e-9
        return path_score(f, cand, len(toks), gold) - pii._lse(scores)

    g = pii.gradient(field, cand, len(toks), set(gold))
    for key in ((0, "email"), (3, "ip"), (1, "any"), (0, 3), (3, pii.OUT), (pii.OUT, 0), (pii.OUT, pii.OUT)):
        up, down = (pii.Field(field.weights | {key: field.weights[key] + d}) for d in (1e-5, -1e-5))
        assert abs((likelihood(up) - likelihood(down)) / 2e-5 - g[key]) < 1e-4


def test_held_out_accuracy():
    field = pii.train()
    found = wanted = right = 0
    for text, gold in pii.sentences(800, seed=77):
        got = {(s, s + n, pii.TYPES.index(k)) for k, s, n in pii.entities(field, text)}
        found, wanted, right = found + len(got), wanted + len(gold), right + len(got & set(gold))
    assert right / found > 0.95 and right / wanted > 0.95


def test_known_cases():
    field = pii.train()
    one = lambda t: [(k, t[s : s + n]) for k, s, n in pii.entities(field, t)]
    assert one("write to jan.doe@mail.example.com today") == [("EMAIL", "jan.doe@mail.example.com")]
    assert one("Call +1 (555) 010-2299.") == [("PHONE", "+1 (555) 010-2299")]
    assert one("server 192.168.10.4, version 1.2.3") == [("IP", "192.168.10.4")]
    assert one("paid with 4111 1111 1111 1111 yesterday") == [("CARD", "4111 1111 1111 1111")]
    assert one("in 2024 we sold 1234 of 99 kinds for $1,200.50") == []
    assert pii.redact(field, "mail a.b@c.org!") == "mail [EMAIL]!"


def test_edge_cases(spark, corpus, nothing):
    assert pii.find_pii(corpus).collect() == [] and pii.find_pii(nothing).collect() == []
    long = "word " * 100_000 + "a.b@c.org " + "x = 1 " * 2000 + "9" * 5000
    df = spark.createDataFrame([(1, long), (1, long), (None, "a.b@c.org"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["type"], r["start"], r["length"]) for r in pii.find_pii(df).collect()), key=repr)
    assert got == [(1, "EMAIL", 500_000, 9), (1, "EMAIL", 500_000, 9), (None, "EMAIL", 0, 9)]


def test_long_tokens_and_values_of_letters():
    field = pii.train()
    one = lambda t: [(k, t[s : s + n]) for k, s, n in pii.entities(field, t)]
    digest, mail, letters = "0a1b2c3d" * 16, "a1" * 50 + "@example.org", "q" * 120
    assert one(f"digest {digest} end") == [("SECRET", digest)]
    assert one(f"write to {mail} now") == [("EMAIL", mail)]
    assert one(f"see ghp_{letters} there") == [("SECRET", "ghp_" + letters)]
    assert one(f"password={'Ab1' * 40}") == [("SECRET", "Ab1" * 40)]
    web = f"eyJ{'hbGci-' * 20}.eyJ{'zd_Wi' * 30}.{'Sfl-Kx' * 9}"
    assert one(f"Authorization: Bearer {web}, next") == [("SECRET", web)]
    assert one("from 2001:db8:0:1:2:3:4:5, fe80::1ff:2 and ::1.") == [("IP", "2001:db8:0:1:2:3:4:5"), ("IP", "fe80::1ff:2"), ("IP", "::1")]
    assert one("at 10:20:30 std::vector a::b() ratio 3:4") == []
    assert one("password: swordfish") == [("SECRET", "swordfish")] == one("password = swordfish")
    assert one("password: hunterabc") == [("SECRET", "hunterabc")]
    assert one(f"its secret :\n{letters} ends") == [("SECRET", letters)]
    assert one("the secrets are: kept well") == one("a key, hunterabc") == []


def test_outside_of_islands_is_no_entity():
    field, r = pii.train(), random.Random(8)
    parts = ["word", "Password", "api_key:", "token :", "key", ":", "hunterabc", "abcdefgh", "x" * 90, "a1" * 60, "sk-abcdef-ghijklmn", "DE12", "ABCD", "12.3.4.5", "a.b@c.org", "=", "q" * 85 + ",", "\n"]
    for _ in range(300):
        text = " ".join(r.choice(parts) for _ in range(14))
        toks = pii.tokens(text, 0, len(text))
        whole = [(pii.TYPES[k], toks[i][0], toks[i + n - 1][1] - toks[i][0]) for i, n, k in pii.decode(field, text, toks)]
        assert pii.entities(field, text) == whole
