"""The operators' parts that need no session, against brute force."""

import math
import random
import re

import numpy as np
import pytest
from palimpsest.llm import html, jaccard, media, pii, quality

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(d)]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return [(s, pii.BASE[k], e) for s, k, e in sorted(found)]


def test_base_spans():
    r = random.Random(5)
    for _ in range(4000):
        text = "".join(r.choice("ab@.. -+1234()%_xé") for _ in range(r.randint(0, 120)))
        assert pii.base_spans(text) == brute_spans(text)
    for long in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "@" * 100_000, "+1 (" * 50_000):
        pii.base_spans(long)


def plain_posteriors(patterns, rounds=200):
    """Expectation-maximisation restated with dictionaries."""
    votes = (-1, 0, 1)
    p = {x: min(0.95, max(0.05, 0.5 + 0.15 * sum(x[1]))) for x in patterns}
    for _ in range(rounds):
        chance = {}
        for side in (0, 1):
            for kind in pii.KINDS:
                for j in range(len(pii.LABELERS)):
                    got = {v: 2 + 2 * (v == (1 if side else -1)) + sum(x[2] * (p[x] if side else 1 - p[x]) for x in patterns if x[0] == kind and x[1][j] == v) for v in votes}
                    chance[side, kind, j] = {v: got[v] / sum(got.values()) for v in votes}
        new = {}
        for x in patterns:
            same = [y for y in patterns if y[0] == x[0]]
            prior = (sum(y[2] * p[y] for y in same) + 1) / (sum(y[2] for y in same) + 2)
            z = math.log(prior / (1 - prior)) + sum(math.log(chance[1, x[0], j][v] / chance[0, x[0], j][v]) for j, v in enumerate(x[1]))
            new[x] = 1 / (1 + math.exp(-max(-30, min(30, z))))
        settled = max(abs(new[x] - p[x]) for x in patterns) < 1e-6
        p = new
        if settled:
            break
    return p


def test_expectation_maximisation_and_classifier():
    r = random.Random(8)
    patterns = sorted({(r.choice(pii.KINDS), tuple(r.choice((-1, 0, 1)) for _ in pii.LABELERS)): r.randint(1, 2000) for _ in range(40)}.items())
    patterns = [(k, v, n) for (k, v), n in patterns]
    want = plain_posteriors(patterns)
    got, reliability = pii.expectation_maximisation(patterns)
    assert all(abs(a - want[x]) < 1e-4 for x, a in zip(patterns, got)) and set(reliability) == set(pii.LABELERS)
    # The classifier is where the gradient of its loss vanishes.
    rows = [sorted(r.sample(range(pii.WIDTH), 8)) for _ in range(60)]
    weight, goal = np.array([r.random() * 50 for _ in rows]), np.array([r.random() for _ in rows])
    w = pii.fit_classifier(rows, weight, goal)
    gradient = w.copy()
    for x, n, y in zip(rows, weight, goal):
        gradient[x] += n * (1 / (1 + math.exp(-w[x].sum())) - y)
    assert np.abs(gradient).max() < 1e-3


def test_span_model_and_redaction():
    texts = ["My token = 'a81f00bd77c1e5590f3e' is secret", "card 4929 0312 7755 1098 123 used", "version 20240101202401 of 11111111111111111", "commit 3f786850e387550fdab836ed7e6dc881de23001b", "mail a@b.com now", "born 12/03/1984, due 12/03/2024"]
    found = [(pii.extra_candidates(t, pii.base_spans(t)), t) for t in texts]
    kinds = [[k for _, k, _ in c] for c, _ in found]
    assert kinds[0] == ["secret"] and kinds[3] == ["secret"] and kinds[4] == [] and kinds[5] == ["birth_date"]
    rows = []
    for (c, t), n in zip(found, (500, 500, 400, 400, 1, 300)):
        for s in c + pii.base_spans(t):
            rows.append((s[1], pii.votes(t, s), pii.features(t, s, pii.votes(t, s)), n))
    model = pii.fit([(k, v, n) for k, v, _, n in rows], [(k, v, x, 1) for k, v, x, _ in rows])
    assert pii.spans(texts[0], model)[1] != [] and pii.spans(texts[2], model)[1] == []
    likely = [model.probability(x) for _, _, x, _ in rows if pii.KINDS.index("secret") + pii._AT_KIND in x]
    assert len(likely) == 2 and likely[0] > likely[1]  # named a token; named a commit
    assert pii.spans("Mr Alan Marsh", pii.fit([], []))[1] == []
    assert pii.redact_text(texts[4], pii.spans(texts[4], model)[1]) == "mail [EMAIL] now"
    for long in ("(" * 100_000, "Anna " * 40_000, "1234 5678 " * 40_000, "a1" * 100_000, "+12 345 678 901 " * 10_000 + "token = abcdef0123456789abcd " * 5000):
        pii.extra_candidates(long, pii.base_spans(long))


def test_pieces_equal_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    from palimpsest.llm.pieces import piece_model

    model, sp, r = piece_model(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(1)
    texts = ["", " ", "a" * 500, " " * 100, "   x  y\t\n", "日本語𐍈　ﬁ①" * 30, "the quick brown " * 50]
    texts += ["".join(r.choice("ab e.\n1  é日𐍈=-_thein") for _ in range(r.randint(1, 200))) for _ in range(300)]
    for text in texts:
        assert model.encode(text).tolist() == sp.encode(text)
        assert model.decode(model.encode(text).tolist()) == text
        if text:
            ids, widest = model.viterbi("▁" + text.replace(" ", "▁"))
            assert ids == sp.encode(text) and widest <= 4 * model.longest


def test_shingle_signatures_and_blocks():
    bands, rows = jaccard.bands_for(0.8, 0.995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.995
    r, sign = random.Random(2), jaccard.Signer(bands, rows)
    base = [str(r.randrange(10**6)) for _ in range(300)]
    texts = [" ".join(w if r.random() > 0.01 * k else "new" + str(r.random()) for w in base) for k in range(6) for _ in range(8)]
    sets = [jaccard.shingles(t) for t in texts]
    ids = np.array(r.sample(range(1000), len(texts)))
    n, d, root = jaccard.verify_block(ids, np.full(len(ids), 2), np.zeros(len(ids), int), np.array([sign(s) for s in sets]), sets, 0.8, True)
    plain = [set(s.tolist()) for s in sets]
    want = [sum(i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(plain)) for i, a in enumerate(plain)]
    assert n.tolist() == want and d.tolist() == [2 * x for x in want]
    assert all(root[i] == min(ids[j] for j in range(len(ids)) if root[j] == root[i]) for i in range(len(ids)))
    assert len(jaccard.shingles("one two")) == 1 and len(jaccard.shingles("")) == 0 and len(jaccard.shingles("!!!")) == 1


def test_chunks_follow_the_rolling_hash():
    r = random.Random(3)
    data = bytes(r.randrange(256) for _ in range(50_000))
    h, ends, at = 0, [], 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(media._GEAR[b])) & 0xFFFFFFFF
        size = i + 1 - at
        if len(data) - at > media.LEAST and size >= media.LEAST and (h >> (32 - media.MASK_BITS) == 0 or size == media.MOST):
            ends.append(i + 1)
            at = i + 1
    if at < len(data):
        ends.append(len(data))
    assert media.cuts(data) == ends
    assert media.from_media(media.to_media("é" * 300)[0]) == ("é" * 300).encode() + b" " * (768 - 600)
    assert len(media.from_media(media.to_media(None)[0])) == 192


def test_main_text():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav>Menu</nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>One\n two<br>three<p>Four"
        "<script>x='</p>'</script><aside>Side</aside><div class='comments'><p>me too</p></div></article><footer>(c)</footer></body></html>"
    )
    assert html.extract(page) == "A & B\n\nOne two three\n\nFour"
    assert html.extract(None) == html.extract("") == ""
    assert html.extract("<p>a<p>b</p><ul><li>c<li>d</ul>") == "a\n\nb\n\nc\n\nd"
    assert html.extract("x < y <b>z") == "x < y z"
    html.extract("<div>" * 20_000 + "deep")


def test_quality_learns():
    r = random.Random(4)
    clean = [" ".join(r.choice("alpha beta gamma delta".split()) for _ in range(60)) for _ in range(60)]
    junk = [" ".join(r.choice("alpha beta gamma".split()) + "%%%" for _ in range(60)) for _ in range(60)]
    model = quality.fit([quality.features(t) for t in clean + junk], np.array([1] * 60 + [0] * 60))
    assert min(model.score(quality.features(t)) for t in clean) > 0.5 > 0.3 > max(model.score(quality.features(t)) for t in junk)
    assert quality.fit([], np.zeros(0, int)).score(quality.features("x")) == pytest.approx(0.5)
    assert 0 <= model.score(quality.features(None)) <= 1


def test_names_that_only_hint_keep_what_is_the_pages_own():
    page = "<body><nav>Home</nav><article><h1>Networks</h1><section id='ad-hoc-networks'><p>Own text of a section.</p></section><div class='comment-policy'>How we moderate.</div><p>Let <math><mi>x</mi></math> be.</p>{}</article></body>"
    want = "Networks\n\nOwn text of a section.\n\nHow we moderate.\n\nLet x be."
    assert html.extract(page.format("")) == want
    for gone in ("<div class='ad-slot-3'>Buy</div>", "<section id='comments'><p>First!</p></section>", "<div class='comment-list'>Second</div>", "<ul class='ad'><li>Buy</li></ul>", "<div class='reader-comments'>Third</div>",
                 "<p hidden>unseen</p>", "<div class=x style='color:red; display: none'>unseen</div>"):
        assert html.extract(page.format(gone)) == want
    assert "seen" in html.extract(page.format("<p class='hidden-gems' style='display:block'>seen</p>"))
    # Shared by the pages of a host, such a block goes.
    found = [(n, t) for n, t, _, place in html.judged(html.parse(page.format(""))) if place == html.PLAIN]
    assert [t for _, t in found] == ["Own text of a section.", "How we moderate."]
    assert html.extract(page.format(""), {html._content(*found[1]): 20}) == want.replace("\n\nHow we moderate.", "")
