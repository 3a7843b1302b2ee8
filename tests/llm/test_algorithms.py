"""The operators' algorithms against brute force, without Spark."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quernlake.llm import fmindex, html, media, minhash, mixing, quality, sharding, suffix, textvec, tokencount, toxicity


# ---- words

@given(st.lists(st.text(max_size=40), max_size=8))
def test_batches_tokenise_like_single_texts(texts):
    found = [(at + d, w.hashes[w.first[d] : w.first[d + 1]].tolist()) for at, w in textvec.chunks(pa.array(texts, pa.string()), "words", lower=True, size=16) for d in range(len(w.first) - 1)]
    assert found == [(k, textvec.hash_words(t).tolist()) for k, t in enumerate(texts)]


def test_words():
    assert textvec.word_list("The cat_1, Élan!") == ["the", "cat_1", "élan"] and textvec.word_list(" .!") == []
    assert len(set(textvec.hash_words("a b ab ba").tolist())) == 4


# ---- suffix sorting

@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(items):
    assert suffix.suffix_array(np.array(items, dtype=np.int64)).tolist() == sorted(range(len(items)), key=lambda k: items[k:])


@given(st.lists(st.integers(0, 2), min_size=1, max_size=80), st.integers(2, 12))
def test_bounded_refinement(items, depth):
    """Suffixes of one bucket share the depth, and the order is that of the beginnings: equal ones are neighbours."""
    bucket = suffix.refine(suffix.ranks(np.array(items, dtype=np.int64)), 1, depth)
    keys = [tuple(items[k : k + depth]) for k in range(len(items))]
    order = np.argsort(bucket, kind="stable").tolist()
    assert [keys[k] for k in order] == sorted(keys)
    assert all(keys[a] == keys[b] for a, b in zip(order, order[1:]) if bucket[a] == bucket[b])


def test_buckets_are_sorted_on_what_refinement_has_found_already():
    """Prefix doubling would sort each suffix of copies of 600 items ten times."""
    rng = np.random.default_rng(7)
    one = rng.integers(0, 5000, 600)
    items = np.concatenate([np.r_[one, 6000 + k] for k in range(40)])
    work = []
    bucket = suffix.refine(suffix.ranks(items), 1, left=np.tile(np.arange(601, 0, -1), 40), work=work)
    assert np.array_equal(np.argsort(bucket), suffix.suffix_array(items)) and len(set(bucket.tolist())) == len(items)
    assert sum(work) < 3.5 * len(items)


@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 9))
def test_least_gram_of_each_window(values, w):
    g = np.array(values, dtype=np.uint64)
    expected = [max(k for k in range(s, s + w) if values[k] == min(values[s : s + w])) for s in range(len(values) - w + 1)]
    assert suffix._selected(g, w).tolist() == expected


# ---- FM-index

@settings(deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=120), st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=4), min_size=1, max_size=6))
def test_fm_index_finds_all_occurrences(symbols, phrases):
    index = fmindex.FMIndex(np.array(symbols), sample=4)
    table = np.array([[0] * (4 - len(p)) + p for p in phrases])
    lo, hi = index.search(table)
    for p, a, b in zip(phrases, lo, hi):
        expected = [k for k in range(len(symbols)) if symbols[k : k + len(p)] == p]
        assert b - a == len(expected) and sorted(index.locate(np.arange(a, b)).tolist()) == expected


@given(st.lists(st.integers(0, 9), min_size=1, max_size=200), st.integers(0, 9))
def test_wavelet_ranks(symbols, c):
    w = fmindex.Wavelet(np.array(symbols), 9)
    at = np.arange(len(symbols) + 1)
    assert w.rank(np.full(len(at), c), at).tolist() == [symbols[:k].count(c) for k in at]
    found, rank = w.access(np.arange(len(symbols)))
    assert found.tolist() == symbols and rank.tolist() == [symbols[:k].count(symbols[k]) for k in range(len(symbols))]


# ---- MinHash

def test_densified_estimates_are_unbiased():
    rnd = random.Random(1)
    errors = []
    for n in (6, 40, 400):
        for share in (0.3, 0.6, 0.9):
            for _ in range(12):
                a = [rnd.getrandbits(64) for _ in range(n)]
                b = a[: int(n * share)] + [rnd.getrandbits(64) for _ in range(n - int(n * share))]
                grams = np.array(a + b, dtype=np.uint64)
                sig, some = minhash.sketch(grams, np.repeat([0, 1], n), 2)
                errors.append((sig[0] == sig[1]).mean() - len(set(a) & set(b)) / len(set(a) | set(b)))
    assert abs(np.mean(errors)) < 0.02 and some.all()


@pytest.mark.parametrize("size", [5, 40, 1000])
def test_links_join_what_all_pairs_would(size):
    """Rows of which none to two thirds of the bins are edited copies of a centre or one of two others, in blocks."""
    rng = np.random.default_rng(3)
    hubs = rng.integers(0, 65536, (3, minhash.BINS)).astype(np.uint16)
    rows = [hubs[0]] + [hubs[k % 3].copy() for k in range(90)] + list(hubs[1:])
    for row in rows[1:91]:
        at = rng.choice(minhash.BINS, rng.integers(70, 170), replace=False)
        row[at] = rng.integers(0, 65536, len(at))
    sig = np.array(rows)
    near = (sig == sig[0]).mean(axis=1)

    def joined(pairs):
        of = list(range(len(sig)))
        for a, b in pairs:
            old, new = of[a], of[b]
            of = [new if x == old else x for x in of]
        return {frozenset(k for k, x in enumerate(of) if x == y) for y in of}

    alike = (sig[:, None] == sig[None]).mean(axis=2) >= minhash.SIMILARITY
    far, like = np.flatnonzero(near < minhash.SIMILARITY), np.flatnonzero(near >= minhash.SIMILARITY)
    blocks = lambda x: [x[k : k + size] for k in range(0, len(x), size)]
    found = [(k, 0) for k in like]
    for i, one in enumerate(blocks(far)):
        for other, within in [(one[:0], True)] + [(x, False) for x in blocks(far)[i + 1 :] + blocks(like)]:
            both = np.r_[one, other]
            a, b = minhash.links(sig[both], near[both], np.r_[np.zeros(len(one)), np.ones(len(other))], within)
            assert alike[both[a], both[b]].all()
            found += zip(both[a], both[b])
    assert joined(found) == joined(np.argwhere(alike))


# ---- tokens

RANKS = tokencount.load_ranks()


def test_token_counts_are_those_of_the_encoder():
    own, other = tokencount.counter(tokencount.VOCABULARY), tiktoken.Encoding("t", pat_str=tokencount.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    rnd = random.Random(3)
    texts = ["", " ", "\n\n  x", "don't I'll", "<|endoftext|>", "naïve 漢字 🎉🎉", "a" * 5000, "The quick brown fox", "1234567 %%%###"]
    texts += ["".join(rnd.choice("ab é1 \n'.,s日") for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert own.count(t)[0] == len(other.encode_ordinary(t)), t


def test_whole_tokens_are_proved_by_merging():
    whole = tokencount.whole_tokens(RANKS)
    other = tiktoken.Encoding("t", pat_str=tokencount.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    for token in random.Random(5).sample(sorted(whole), 300):
        assert other._encode_single_piece(token) == [RANKS[token]]
    assert len(whole) > 0.9 * len(RANKS)


# ---- HTML

PAGE = """<html><head><title>A &amp; B</title><script>var x="<p>no</p>";</script></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav>
<div class="ad-box">Buy this thing now because it is cheap.</div><h1>The heading of it</h1><p>{0}<p>{1}<br>{1}</p><footer>&copy; all rights reserved by us</footer></body></html>"""


def test_content_is_kept_and_boilerplate_is_not():
    title, text, lines, kept = html.extract(PAGE.format("First paragraph with many words. " * 5, "Second one, which is long as well. " * 6))
    assert title == "A & B" and text.count("First paragraph") == 5 and text.count("Second one") == 12
    assert not any(x in text for x in ("Home", "About", "<p>", "no</p>")) and lines > kept > 0


def test_odd_pages():
    assert html.extract(None) == ("", "", 0, 0) and html.extract("") == ("", "", 0, 0) and html.extract("<br>")[1] == ""
    assert html.extract("just text")[1] == "just text" and html.extract("<p>a</b></p></div><p>unclosed <b>words go on")[1] != ""
    assert html.extract("<![foo[bar]]>x")[1] == "x" and html.extract("a <!-- b")[1] == "a <!-- b" and html.extract("a < b <c")[1] == "a < b <c"
    assert html.extract("<svg>text <p>after</p>")[1] == "text\nafter" and html.extract("x<svg>drawn</SVG >y")[1] == "xy" and html.extract("x<script>y")[1] == "x"
    long = "<div>" * 5000 + "word " * 50000
    assert len(html.extract(long)[1]) == 5 * 50000 - 1
    pieces = PAGE.format("x y z " * 30000, "q " * 40)
    assert html.extract(pieces)[1].count("x y z") == 30000


@pytest.mark.parametrize("start, end", [
    ('<body class="has-sidebar">', "</body>"), ('<body class="sidebar">', "</body>"), ('<div class="nav-open">', "</div>"), ("<form action=x>", "</form>"), ('<div id="menu">', "</div>"), ("<nav>", "</nav>"), ("<a name=top>", ""), ("<a href=x>", ""), ('<a title="x>', ""),
])
def test_no_name_tag_or_unclosed_anchor_loses_a_page(start, end):
    words = ["First paragraph with many words. " * 5, "Second one, which is long as well. " * 6]
    text = html.extract(f"<html>{start}<div><a href=/a>Home</a></div><p>{words[0]}<p>{words[1]}<br>{words[1]}</p>{end}</html>")[1]
    assert text.count("First paragraph") == 5 and text.count("Second one") == 12 and "Home" not in text


@pytest.mark.parametrize("part", ["a<b ", '<a b="', "<!--a<", "<a b='\"'>", "<![foo[bar]]>", "&#", "</", "<script>", "<svg>", "<title>", "<!", "<a href=x>y", "=\'\"<a>"])
def test_any_page_takes_time_in_proportion_to_its_length(part):
    def seconds(n):
        began = time.process_time()
        html.extract(part * (n // len(part)))
        return time.process_time() - began

    assert seconds(400_000) < 6 * max(0.1, seconds(100_000)) and seconds(1_000_000) < 8


@given(st.text(alphabet="<>/!-ab =\"'&;\n[]?", max_size=60))
def test_no_page_crashes_and_its_constructs_are_all_of_it(page):
    html.extract(page)
    assert "".join(html.Pieces(page.replace("<", ""))) == page.replace("<", "")


def test_smoothing_and_threshold():
    assert html.smoothed([5.0] * 7) == pytest.approx([5.0] * 7) and html.smoothed([0, 0, 9, 0, 0])[2] == max(html.smoothed([0, 0, 9, 0, 0]))
    assert html.threshold([0, 1, 0, 9, 10]) == 9 and html.threshold([3, 3]) == 3 and html.threshold([]) == 0.0 and html.threshold(list(range(50))) == 0


@given(st.lists(st.floats(0, 9, width=16), max_size=30))
def test_smoothing_and_threshold_are_those_of_brute_force(values):
    kernel = {k: np.exp(-(k**2) / 2) for k in range(-2, 3)}
    plain = [sum(w * values[i + k] for k, w in kernel.items() if 0 <= i + k < len(values)) / sum(w for k, w in kernel.items() if 0 <= i + k < len(values)) for i in range(len(values))]
    assert html.smoothed(values) == pytest.approx(plain)
    within = {c: sum(np.var(p) * len(p) for p in ([v for v in values if v < c], [v for v in values if v >= c])) for c in set(values) if c > min(values)}
    cut = html.threshold(values, 0.0)
    assert cut == min(values, default=0.0) if not within else within[cut] == pytest.approx(min(within.values()), abs=1e-9)


# ---- toxicity

LEXICON, MACHINE = toxicity.Lexicon.of({}), toxicity.Machine(toxicity.grammar())


@pytest.mark.parametrize("text, toxic", [
    ("You are an idiot.", True), ("What a worthless moron", True), ("I will kill you tomorrow.", True), ("Du bist ein Idiot, ein Dummkopf!", True),
    ("He is not an idiot.", False), ("She said that he was an idiot.", False), ('The note "what an idiot" was found.', False), ("They will kill the lights and go.", False), ("", False), ("A calm and pleasant day.", False),
    ("She said hello.\nYou idiot", True),
])
def test_clauses(text, toxic):
    total, _ = toxicity.scores(pa.array([text]), LEXICON, MACHINE)
    assert (total[0] >= toxicity.THRESHOLD) == toxic, total


def test_long_clean_documents_do_not_add_up():
    weak = {int(textvec.hash_words(x)[0]): 0.6 for x in ("foul", "sour")}
    filler = "the weather was calm and the road was long. " * 2000
    for text in (
        filler + "It went foul. " + filler + "The milk was sour. " + filler, 'The report said "what an idiot" once. ' * 12 + filler, "He is not an idiot. " * 12,
        'The report said "idiot, moron, idiot, moron, idiot, moron" once.', "A pathetic excuse. ", "Das ist dumm gelaufen. ", ("calm words " * 200 + "pathetic ") * 2,
    ):
        assert toxicity.scores(pa.array([text]), toxicity.Lexicon.of(weak), MACHINE)[0][0] < toxicity.THRESHOLD, text[:50]
    assert toxicity.scores(pa.array([filler + "You idiot. " + filler]), toxicity.Lexicon.of(weak), MACHINE)[0][0] >= toxicity.THRESHOLD


@given(st.lists(st.integers(0, 6), max_size=20))
def test_compiled_machine_equals_running_the_transducers_in_turn(symbols):
    parts = [toxicity.negation(), toxicity.reported(), toxicity.targets(), toxicity.insults(), toxicity.threats()]
    states, total = [0] * len(parts), 0.0
    for s in symbols:
        for k, t in enumerate(parts):
            states[k], s, w = t.step(states[k], s)
            total += w
    assert MACHINE.score(symbols, [1.0] * len(symbols)) == pytest.approx(total)


# ---- media

def test_jpeg_round_trip():
    rng = np.random.default_rng(1)
    image = np.clip(np.cumsum(rng.normal(0, 4, (32, 48, 3)), axis=1) + 120, 0, 255).astype(np.uint8)
    image[:, :, 1:] = image[::2, ::2, 1:].repeat(2, 0).repeat(2, 1)
    for tables in (False, True):
        out = media.decode_jpeg(media.encode_jpeg(image, 1, tables))
        assert out.shape == image.shape and np.abs(out.astype(int) - image).max() <= 3


@pytest.mark.parametrize("seed", range(6))
def test_shots_are_those_drawn(seed):
    data, lengths = media.film([0.3, -1.2, 2.0], seed)
    found = media.clips(data)
    assert [c[3] for c in found] == lengths and found[0][1] == 0 and found[-1][2] == 40.0 * sum(lengths)


@pytest.mark.parametrize("colour", [False, True])
@pytest.mark.parametrize("levels", [(0, 255, 0), (100, 125, 90)])
def test_cuts_of_gray_and_muted_films(levels, colour):
    rng = np.random.default_rng(6)
    frames = []
    for n, level in enumerate(levels):
        for k in range(7):
            image = np.full((16, 16, 3), 128.0)
            image[:, :, 0] = level + rng.normal(0, 2, (16, 16)) + np.linspace(-8, 8, 16)
            image[:, :, 1:] += 3 * (n % 2) * colour
            frames.append(media.encode_jpeg(np.clip(image, 0, 255).astype(np.uint8)))
    data = media.write_avi(frames, 40000, 16, 16)
    assert [c[3] for c in media.clips(data)] == [7, 7, 7]
    flat = media.write_avi(frames[:7] * 3, 40000, 16, 16)
    assert [c[3] for c in media.clips(flat)] == [21]


def test_key_flags_of_motion_jpeg_do_not_count():
    data, lengths = media.film([0.3, -1.2, 2.0], 2)
    data = media.write_avi([data[a:b] for a, b in media.Avi(data).frames], 40000, 16, 16)
    at = data.rindex(b"idx1") + 8
    none = bytearray(data)
    for k in range(at + 4, len(data), 16):
        none[k : k + 4] = bytes(4)
    assert bytes(none) != data and [c[3] for c in media.clips(bytes(none))] == lengths


def test_damaged_files():
    data, lengths = media.film([0.1], 1)
    assert media.clips(None) == [] and media.clips(b"") == [] and media.clips(b"RIFF") == [] and media.clips(data[:40]) == []
    cut = bytearray(data)
    cut[cut.index(b"\xff\xd8") + 2] = 0  # the first frame is no image any more
    assert sum(c[3] for c in media.clips(bytes(cut))) == sum(lengths)
    assert sum(c[3] for c in media.clips(data.replace(b"idx1", b"junk"))) == sum(lengths)


def test_sizes_restarts_and_indexes():
    rng = np.random.default_rng(2)
    for height, width in ((9, 23), (40, 17), (64, 64)):
        image = np.clip(np.cumsum(rng.normal(0, 4, (height, width, 3)), axis=1) + 120, 0, 255).astype(np.uint8)
        plain = media.decode_jpeg(media.encode_jpeg(image, 2))
        assert plain.shape == image.shape and np.abs(plain[:, :, 0].astype(int) - image[:, :, 0]).mean() < 3
        for restart in (1, 2, 5):
            assert np.array_equal(media.decode_jpeg(media.encode_jpeg(image, 2, restart=restart)), plain)
    frames = [media.encode_jpeg(np.full((16, 16, 3), 10 * k, np.uint8)) for k in range(13)]
    spans = [[data[a:b] for a, b in media.Avi(data).frames] for data in (media.write_avi(frames, 40000, 16, 16, i) for i in ("idx1", "indx", "none"))]
    assert spans == [frames] * 3


def test_scans_of_one_component_each():
    """Not interleaved: each component's blocks in rows of their own."""
    rng = np.random.default_rng(3)
    planes = [np.clip(np.cumsum(rng.normal(0, 4, (h, w)), axis=1) + 120, 0, 255) for h, w in ((24, 40), (16, 24), (16, 24))]
    scans = []
    for p in planes:  # a gray file of each plane has its scan
        image = np.full((*p.shape, 3), 128, np.uint8)
        image[:, :, 0] = p
        scans.append(image)
    whole = media.encode_jpeg(np.full((24, 40, 3), 128, np.uint8), 2)
    head = whole[: whole.index(b"\xff\xda")]

    def scan(image, component):
        data = _gray_scan(image)
        return b"\xff\xda\x00\x08\x01" + bytes([component, 0, 0, 63, 0]) + data

    data = head + b"".join(scan(i, k + 1) for k, i in enumerate(scans)) + b"\xff\xd9"
    out = media.decode_jpeg(data)
    assert out.shape == (24, 40, 3) and np.abs(out[:, :, 0].astype(int) - planes[0]).mean() < 3
    chroma = planes[1][:12, :20].repeat(2, 0).repeat(2, 1)
    assert np.abs(out[:, :, 1].astype(int) - chroma).mean() < 3


def _gray_scan(image):
    """Entropy-coded blocks of one plane, in rows, by the luma tables."""
    h, w, _ = image.shape
    blocks = (image[:, :, 0].astype(float) - 128).reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    coef = np.rint((media._DCT @ blocks @ media._DCT.T).reshape(-1, 64)[:, media.ZIGZAG] / 2).astype(int)
    dc, ac, bits, last = media._codes(media._DC), media._codes(media._AC), "", 0

    def put(code, length):
        nonlocal bits
        bits += format(code, f"0{length}b")

    for block in coef.tolist():
        d, last = block[0] - last, block[0]
        n = abs(d).bit_length()
        put(*dc[n])
        if n:
            put(d if d > 0 else d + (1 << n) - 1, n)
        run = 0
        for v in block[1:]:
            if not v:
                run += 1
                continue
            while run > 15:
                put(*ac[0xF0])
                run -= 16
            n = abs(v).bit_length()
            put(*ac[run << 4 | n])
            put(v if v > 0 else v + (1 << n) - 1, n)
            run = 0
        if run:
            put(*ac[0])
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")


def test_decoding_takes_time_in_proportion_to_the_bytes():
    rng = np.random.default_rng(1)
    images = [np.clip(np.cumsum(rng.normal(0, 4, (n, n, 3)), axis=1) + 120, 0, 255).astype(np.uint8) for n in (128, 512)]
    small, large = (media.encode_jpeg(i, 4) for i in images)
    times = []
    for data in (small, large):
        began = time.process_time()
        media.decode_jpeg(data)
        times.append((time.process_time() - began) / len(data))
    assert len(large) > 10 * len(small) and times[1] < 3 * times[0]


def test_no_bytes_make_clips_fail():
    rnd = random.Random(1)
    films = [media.film([0.3, -1.2, 2.0], k)[0] for k in range(21)]
    for k in range(300):
        data = bytearray(films[k % len(films)])
        for _ in range(rnd.choice([1, 3, 10, 60])):
            data[rnd.randrange(len(data))] = rnd.choice([0, 255, rnd.randrange(256)])
        media.clips(bytes(data[: rnd.randrange(len(data))] if k % 3 == 0 else data))
    frame = bytearray(media.encode_jpeg(np.zeros((16, 16, 3), np.uint8)))
    at = frame.index(b"\xff\xc0")
    for change in ({11: 0}, {11: 0x55}, {5: 255, 6: 255, 7: 255, 8: 255}, {9: 0}, {4: 12}):  # sampling, size, components, depth
        bad = bytearray(frame)
        for k, v in change.items():
            bad[at + k] = v
        with pytest.raises(media.BadImage):
            media.decode_jpeg(bytes(bad))
    # an index of indexes that leads to itself, many times
    data = bytearray(media.write_avi([bytes(frame)] * 10, 40000, 16, 16, "indx"))
    a = data.index(b"indx")
    data[a + 12 : a + 16] = b"\xff" * 4
    data[a + 32 : a + 40] = a.to_bytes(8, "little")
    assert sum(c[3] for c in media.clips(bytes(data))) in (5, 10)


# ---- mixing, sharding, quality

def test_flight_keeps_documents_and_tokens():
    rng = np.random.default_rng(4)
    tokens, pi = rng.integers(0, 3000, 700), rng.uniform(0.05, 0.95, 700)
    out = mixing.flight(pi, tokens, 1)
    assert abs(out.sum() - pi.sum()) < 1e-6 and abs((out * tokens).sum() - (pi * tokens).sum()) < 1e-3 and ((out > 0) & (out < 1)).sum() <= 2
    done = mixing.landing(out, tokens, 1)
    assert set(done.tolist()) <= {0.0, 1.0} and abs(done.sum() - pi.sum()) < 2


def test_inclusion_is_as_probable_as_asked():
    pi, tokens = np.array([0.2, 0.5, 0.9, 0.4, 0.6, 0.3, 0.1]), np.array([5, 90, 3, 40, 40, 7, 0])
    mean = np.mean([mixing.landing(mixing.flight(pi, tokens, s), tokens, s) for s in range(4000)], axis=0)
    assert np.abs(mean - pi).max() < 0.03


def test_rebalancing_moves_few_slots():
    rnd = random.Random(2)
    size = {s: rnd.randint(1, 100) for s in range(sharding.SLOTS)}
    start = sharding.first_map()
    for s in range(256):  # the first shard grows hot
        size[s] *= 4
    out = sharding.rebalanced(start, size)
    load = [sum(size[s] for s in size if out[s] == k) for k in range(sharding.SHARDS)]
    assert max(load) <= sum(load) / len(load) * 1.02 and sum(a != b for a, b in zip(start, out)) < 400
    fewer, more = sharding.rebalanced(out, size, 5), sharding.rebalanced(out, size, 20)
    for now, shards in ((fewer, 5), (more, 20)):
        load = [sum(size[s] for s in size if now[s] == k) for k in range(shards)]
        assert max(load) <= sum(load) / shards * 1.02 and set(now) == set(range(shards))
    assert sum(a != b for a, b in zip(out, more)) < 1200
    assert sharding.rebalanced(out, size) == out and sharding.rebalanced(start, {}) == start and sharding.rebalanced(start, {7: 9}) == start


def test_batch_scores_are_the_bag_scores():
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=quality.BUCKETS + 1).astype(np.float32), 0.1)
    texts = ["One two two THREE", "a", "", "é\nè  ü", "x " * 3000, None]
    for t, s in zip(texts, model.scores(pa.array(texts, pa.string()))):
        ids, share = quality.bag(t or "")
        assert s == pytest.approx(1 / (1 + np.exp(-(0.1 + float(share @ model.weight[ids] if len(ids) else 0)))), abs=1e-4)


@given(st.text(max_size=12))
def test_texts_of_any_length_have_a_bag(text):
    ids, share = quality.bag(text)
    assert len(ids) == len(share) and share.sum() == pytest.approx(1 if len(ids) else 0)


def test_training_learns_held_out_documents():
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    good = lambda: " ".join(rnd.choice(words) for _ in range(60))
    bad = lambda: rnd.choice([good().upper(), " ".join([rnd.choice(words)] * 60), " ".join(w + "###" for w in good().split())])
    model = quality.train([(good(), 1) for _ in range(300)] + [(bad(), 0) for _ in range(90)])
    held = [(good(), 1) for _ in range(100)] + [(bad(), 0) for _ in range(60)]
    scores = model.scores(pa.array([t for t, _ in held]))
    assert np.mean((scores >= 0.5) == [bool(y) for _, y in held]) >= 0.97
