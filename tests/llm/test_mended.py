"""Faults mended after their operators' first version, each with the case that showed it."""

import collections
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import WORDS, dedup_twin, frame, prose

from scanspark.llm import bit_filter, decontaminate, licenses, line_dedup, near_copies, packing, pii, url_reputation
from scanspark.llm.token_counts import tokenizer


def test_ids_equal_the_library_in_random_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, ids_of, rnd = tokenizer(path), packing.WordIds(path), random.Random(3)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|startoftext|>", "See", "here", "É", "don't", "IT'S", "x", ",", ".", "12", "#", "\n", "\t", "  ", "Ä.", "ÿ", "ΣΑΣ", "İ", "日本", "a" * 250, "́"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) + rnd.choice((" ", "", " ")) for _ in range(rnd.randint(1, 9)))
        assert ids_of.of(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert all(len(w) <= packing.LONGEST for w in ids_of)


def best_fit_twin(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


def test_best_fit_equals_its_twin():
    rnd = random.Random(5)
    for _ in range(400):
        capacity = rnd.choice((10, 30, 100))
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 60))]
        made = packing.best_fit(packing._Lengths(dict(collections.Counter(lengths))), capacity)
        assert sorted(x for p, n in made for x in p * n) == sorted(lengths)
        assert sorted(capacity - sum(p) for p, n in made for _ in range(n)) == best_fit_twin(lengths, capacity)
    assert sorted(packing.best_fit(packing._Lengths({60: 1, 55: 1, 42: 1, 3: 1}), 100)) == [((55, 42, 3), 1), ((60,), 1)]


def test_line_runs_leave_no_table_and_hot_lines_go_the_same_way(spark, monkeypatch):
    rnd = random.Random(2)
    lines = [" ".join(rnd.choices(WORDS, k=9)) for _ in range(8)]
    rows = [(i, "\n".join([lines[0], *rnd.choices(lines, k=3), prose(9, i)])) for i in range(80)]
    for hot, batches in ((0, 1), (4, 3)):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(frame(spark, rows), batch_lines=1000, least_batches=batches).collect()}
        assert got == dedup_twin(rows)
    assert not [t.name for t in spark.catalog.listTables() if re.match("line_run_", t.name)]


def test_alignment_of_a_very_long_item():
    rnd = np.random.default_rng(2)
    item = rnd.integers(0, 5000, 20_000).astype(np.uint64)
    passage = np.concatenate([rnd.integers(5000, 9000, 300).astype(np.uint64), item[:300], item[310:700]])
    assert decontaminate.align(passage, item) == (680, 690, 300, 989)


def jaccard(a, b, size=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(text, share, seed):
    rnd = random.Random(seed)
    return " ".join(w if rnd.random() > share else f"new{rnd.randrange(10**6)}" for w in text.split())


def near_twin(text):
    """Groups of texts linked by a Jaccard similarity of 0.8 or more, over all pairs."""
    root = {d: d for d in text}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {d: shingles_of(t) for d, t in text.items()}
    for a in text:
        for b in text:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in text}


def shingles_of(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


@pytest.mark.parametrize("common", [4, 10**9])
def test_near_copies_equal_all_pairs(spark, monkeypatch, common):
    """Families of copies, chains, passages in many texts, and texts made of passages; with shingles told common early, and with none."""
    monkeypatch.setattr(near_copies, "MOST_PAIRS", 4)
    monkeypatch.setattr(near_copies, "COMMON", common)
    base = {g: prose(120, 600 + g) for g in range(20)}
    shared = [prose(55, 50 + k) for k in range(6)]
    rnd = random.Random(8)
    rows = [(i, t) for i, t in base.items()]
    rows += [(1000 + 100 * g + k, edited(base[g], rnd.choice((0.004, 0.01, 0.02)), 100 * g + k)) for g in range(12) for k in range(20)]
    rows += [(4000 + k, f"{prose(6, k)} {shared[k % 2]} {prose(rnd.randint(1, 8), 900 + k)}") for k in range(60)]
    rows += [(5000 + k, " ".join(rnd.sample(shared, rnd.randint(1, 4)))) for k in range(60)]
    chain = prose(150, 77).split()
    for k in range(25):
        chain[5 * k] = f"x{k}"
        rows.append((6000 + k, " ".join(chain)))
    rows += [(9000 + g, edited(base[g], 0.12, 7000 + g)) for g in range(20)]
    rows += [(20_000 + g, base[g].upper()) for g in range(5)] + [(30_000, "a b c"), (30_001, "A b  c"), (30_002, "a b d"), (30_003, None), (30_004, ""), (30_005, "a b c d e"), (30_006, "a b c d f")]
    want = near_twin(dict(rows))
    got = {r.doc_id for r in near_copies.keep_one(frame(spark, rows)).collect()}
    assert got == set(want.values())
    assert len(got) < 200 and sum(v == 6000 for v in want.values()) == 25


def test_rounds_of_a_bucket_leave_no_pair_out(spark):
    """Every pair of a bucket that the bound allows is met in one round or another, those of weak texts with strong ones, too."""
    rnd = random.Random(3)
    rows = [(7, k, n, max(1, n - rnd.randint(0, n // 5))) for k, n in enumerate(rnd.choices(range(40, 60), k=40))] + [(8, 1, 50, 50), (9, 1, 50, 41), (9, 2, 50, 41)]
    got, left, heads = set(), frame(spark, rows, "h long, key long, n int, cap int"), 2
    while True:
        table = near_copies.met(left, heads, 0.8).collect()
        got |= {frozenset((r.a, r.b)) for r in table if r.b is not None}
        rest = [(r.h, r.a, r.n, r.cap) for r in table if r.h is not None]
        if not rest:
            break
        left, heads = frame(spark, rest, "h long, key long, n int, cap int"), heads * 2
    seven = [r for r in rows if r[0] == 7]
    want = {frozenset((a[1], b[1])) for a in seven for b in seven if a[1] < b[1] and min(a[2], b[2]) >= 0.8 * max(a[2], b[2]) and min(a[3], b[3]) * 1.8 >= 0.8 * (a[2] + b[2])}
    assert got == want and len(want) > 50


def test_bit_filter_holds_its_hashes(spark):
    rnd = random.Random(2)
    own = [rnd.getrandbits(64) - (1 << 63) for _ in range(3000)] + [-1, 0, (1 << 63) - 1, -(1 << 63)]
    held = bit_filter.bit_filter(frame(spark, [(x,) for x in own], "h long"), "h").value
    assert bit_filter.passing(np.array(own, np.int64).view(np.uint64), held).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert bit_filter.passing(others, held).mean() < 0.01


def test_registered_domains_and_hot_hosts(spark, monkeypatch):
    hosts = {"bbc.co.uk": ("bbc.co.uk", "co.uk"), "www.bbc.co.uk": ("bbc.co.uk", "co.uk"), "u@h.example.net:8080": ("example.net", "net"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "[::1]:80": ("[::1]", "[::1]"), "a.b.com.": ("b.com", "com"), "localhost": ("localhost", "localhost"), "": ("", ""), "co.uk": ("co.uk", "co.uk")}
    frame_ = frame(spark, [(h,) for h in hosts], "host string")
    got = {r.host: (r.d, r.s) for r in frame_.select("host", url_reputation.host_domain(F.col("host")).alias("d"), url_reputation.host_suffix(F.col("host")).alias("s")).collect()}
    assert got == hosts
    urls = frame(spark, [(i, f"http://h{i % 7}.site.net/p/{i}" if i % 5 else None) for i in range(200)] + [(0, "http://h0.site.net/p/0")], "page_id long, url string")
    labels = frame(spark, [(i, int(i % 7 != 0), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    seen = []
    for hot in (0, 5, 10_000):
        monkeypatch.setattr(url_reputation, "HOT", hot)
        seen.append(sorted((r.page_id, r.host, r.verdict, round(r.bad_low, 9)) for r in url_reputation.judge_urls(urls, labels).collect()))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 201


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_every_license_is_found_as_itself_and_coverage_is_bounded_by_the_longest_common_subsequence(spark):
    rows = [(i, f"{prose(60, i)} {t} {prose(60, 900 + i)}") for i, t in enumerate(licenses.TEMPLATES.values())]
    got = {(r.doc_id, r.license): r.coverage for r in licenses.find_licenses(frame(spark, rows)).collect()}
    assert got == {(i, n): 1.0 for i, n in enumerate(licenses.TEMPLATES)}
    rnd = random.Random(4)
    for name in ("BSD-3-Clause", "GPL-2.0-or-later", "Zlib"):
        whole = licenses.words_of(licenses.TEMPLATES[name])
        for share in (0.02, 0.1, 0.3):
            text = [w if rnd.random() > share else rnd.choice(("the", "of", "other", "words")) for w in whole]
            n = len(licenses.patience(text, whole))
            assert 0.9 * longest_common(text, whole) <= n <= longest_common(text, whole)


def luhn(n):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(n))) % 10 == 0


def test_more_personal_data(spark):
    gone = {
        1: "4111 1111 1111 1111 123", 2: "4111 1111 1111 1111 12/27", 3: "12 4111 1111 1111 1111", 4: "1234 4111 1111 1111 1111", 5: "3782 822463 10005", 6: "4111-1111-1111-1111 4111-1111-1111-1111",
        10: "DE89 3704 0044 0532 0130 00", 11: "DE89 3704 0044 0532 0130 00 USD", 12: "GB82 WEST 1234 5698 7654 32 EURO", 20: "12/31/1999", 21: "31 Dec 1999", 22: "Dec 31, 1999", 23: "1999/12/31", 24: "1890-05-05", 30: "2001:db8::8a2e:370:7334",
        31: "2001:0db8:0000:0000:0000:8a2e:0370:7334", 40: "josé@example.com", 41: "123 45 6789", 42: "gho_" + "a1B2" * 9, 43: "xoxb-1234567890-abcdef", 44: "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abcDEF123_-x", 45: "020 7946 0958",
    }
    kept = {100: "10:30:15 and a::b, std::vector, ::1, 12:34", 101: "4111 1111 1111 1112 123", 102: "1234 5678 9012 3456 7890", 103: "99/99/1999 and 1500-01-01", 104: "DE89 3704 0044 0532 0130 01", 105: "chapter 3 of 12 in 1999, 000 12 3456"}
    rows = [(i, f"see {t} there") for i, t in (gone | kept).items()]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, rows), "k").collect()}
    text = {i: r.text[4:-6] for i, r in got.items()}
    for i, t in gone.items():
        assert text[i] != t, t
    assert {i: text[i] for i in kept} == kept
    number = re.sub(r"\D", "", text[1])[:16]
    assert luhn(number) and number != "4111" * 4 and text[1].endswith(" 123") and text[2].endswith(" 12/27")
    assert all(re.sub(r"\D", "", text[i]).endswith(number) for i in (3, 4)) and text[3].startswith("12 ") and text[4].startswith("1234 ")
    assert text[6] == "-".join(re.findall("....", number)) + " " + "-".join(re.findall("....", number)) and got[6].n_card == 1
    assert luhn(text[5].replace(" ", "")) and text[11] == text[10] + " USD" and text[12].endswith(" EURO") and re.fullmatch(r"GB\d\d WEST( \d{4}){3} \d\d EURO", text[12])
    iban = text[10].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.fullmatch(r"(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}", text[30]) and text[30] == text[31]
    days = {re.sub(r"\D", "", f"{text[23]}")}
    assert days == {text[20][6:] + text[20][:2] + text[20][3:5]}
