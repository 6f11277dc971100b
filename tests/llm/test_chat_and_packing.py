"""Chat formatting and packing: exact round trips, alignment by brute force, invariants of the packed sequences."""

import hashlib
import random
import statistics
from array import array
from collections import Counter, defaultdict

import pytest

from sparkloom.llm import chat, packing
from sparkloom.llm.queries import CONTROL_TEXT, tokenizer_path

HARD = ["", "ok", CONTROL_TEXT, "<turn>user<text>x</turn>\n", "\\l\\\\<#", "naïve 東京 🙂\r\n\ttab", "\\", "#" * 50, "a" * 5000]


def test_escaping_is_exact_and_hides_marks():
    for t in HARD:
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(m in e for m in (chat.OPEN, chat.BODY, chat.CLOSE, "</turn>", "#"))


def test_align_equals_brute_force():
    rng = random.Random(2)
    for _ in range(500):
        cuts = sorted(rng.sample(range(1, 60), rng.randrange(2, 20)))
        offsets = [(a, b) for a, b in zip(cuts, cuts[1:]) if rng.random() < 0.9]
        marks = sorted(rng.sample(range(60), 6))
        spans = [tuple(marks[i : i + 2]) for i in (0, 2, 4)]
        tokens, covered = chat.align(offsets, spans)
        want = []
        for a, b in spans:
            touching = [i for i, (x, y) in enumerate(offsets) if x < b and y > a]
            if touching:
                want.append((touching[0], touching[-1] + 1))
        assert tokens == want and len(covered) == len(tokens)


def test_conversations_round_trip(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(("user", "assistant", "system", None, "<turn>")), rng.choice([*HARD, None]), "clash"))
    rows += [(None, 0, "user", "x", "c"), (None, 1, "assistant", "y", "c"), (3, None, "assistant", "first", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(6)
    formatted = chat.format_chats(df, tokenizer_path("byte_bpe_50k.json"), at_once=500)
    want = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        want[conv].append(((-1 if turn is None else turn), role or "", text or ""))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    # Each token of the mask lies inside an assistant text, and the mask's tokens cover all of it.
    for r in formatted.collect():
        assert len(r.loss_tokens) == len(r.loss_spans) and all(t.start < t.stop <= len(r.ids) for t in r.loss_tokens)
    assert chat.read_back(chat.format_chats(df.limit(0), tokenizer_path("byte_bpe_50k.json"))).count() == 0


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = [None, "", " ", "Hello, world. It's 3.5 km,you know.", "ÀÉÎ straße İstanbul ǅ", "é å Σίσυφος ΣΑΣ", "東京タワー。🙂👍🏽", " x y​z", "<|endoftext|> <|startoftext|>", "a.b. c,d , e ., f", "\tTab\r\nline\x0bv\x0cf\x85n", "don't we'll I'm he'd they've", "xͅ ᾳ ŉ", "1234567890 " * 50, "W" * 3000, "mixed line\x1cfs", "½ ² ª º K"]


def test_word_encoder_equals_the_tokenizer():
    encode = packing.word_encoder(tokenizer_path("word_bpe_49k.json"), 2)
    rng = random.Random(1)
    alphabet = "abcXYZéÉßİıſµªǅ.,;:'’\"-_ \n\t ́ 東🙂09½<|>"
    texts = [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(3000))]
    got = encode([t or "" for t in texts])
    for t, b, want in zip(texts, got, plain_ids(texts)):
        assert array("I", b).tolist() == want, repr(t)


@pytest.mark.parametrize("block", [1 << 21, 700])
def test_packing_invariants(spark, block):
    rng = random.Random(7)
    texts = [*ODD, *(" ".join(rng.choice(("the", "Zebra", "runs", "über", "42")) for _ in range(rng.choice((3, 20, 90, 900)))) for _ in range(60)), "word " * 30_000]
    rows = [(i, t, 5, 6) for i, t in enumerate(texts)] + [(10_000, "same", 5, 6), (10_001, "same", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long, sequence_id long").repartition(3)
    most = 256
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), 2, max_tokens=most, block_tokens=block).collect()
    ids = dict(zip([r[0] for r in rows], plain_ids([r[1] for r in rows])))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.doc_tokens == len(ids[p.doc_id]) and p.length > 0
        by_doc[p.doc_id].append((p.start, array("I", bytes(p.ids)).tolist()))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert {d: [i for _, part in sorted(x) for i in part] for d, x in by_doc.items()} == ids
    for d, x in by_doc.items():
        at = 0
        for start, part in sorted(x):
            assert start == at
            at += len(part)
    padding = 0
    for x in by_sequence.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= most
        padding += 0 if at & (at - 1) == 0 else most - at
    assert padding <= 0.02 * sum(len(v) for v in ids.values())


def test_packing_balances_cost_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x")], "doc_id long, text string")
    got = Counter(r.doc_id for r in packing.pack(docs, tokenizer_path("word_bpe_49k.json"), 2).collect())
    assert got.keys() == {1, None}
    assert packing.pack(docs.limit(0), tokenizer_path("word_bpe_49k.json"), 2).count() == 0
    rng = random.Random(3)
    lengths = [min(3900, int(rng.lognormvariate(5.5, 1.0)) + 1) for _ in range(6000)]
    cost, used, cuts = defaultdict(float), Counter(), Counter()
    for d, _, n, s, _ in packing.assign(lengths, 4096, 1.0, 1 / 4096):
        cost[s] += n + n * n / 4096
        used[s] += n
        cuts[d] += 1
    assert sum(used.values()) == sum(lengths) and max(used.values()) <= 4096
    full = [cost[s] for s in used if used[s] == 4096]
    # One document of 3,900 tokens costs 7,600 wherever it is; the sequences that no such one dominates are alike.
    tenths = statistics.quantiles(full, n=10)
    assert tenths[6] < 1.1 * tenths[0]
    assert sum(c > 1 for c in cuts.values()) < 0.03 * len(lengths)


def test_blocks_pass_their_rest_on(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i % 9)) for i in range(300)], "doc_id long, text string").coalesce(1)
    used = Counter()
    for r in packing.pack(docs, tokenizer_path("word_bpe_49k.json"), 2, max_tokens=64, block_tokens=500).collect():
        used[r.sequence_id] += r.length
    short = [n for n in used.values() if n < 64]
    assert len(short) == len(set(short)) <= 6 and all(n & (n - 1) == 0 for n in short)


def test_other_tokenizers_encode_each_text_at_once():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    got = packing.word_encoder(path, 7)(packing.PROBES)
    want = [[*e.ids, 7] for e in Tokenizer.from_file(path).encode_batch(packing.PROBES, add_special_tokens=False)]
    assert [array("I", b).tolist() for b in got] == want


def test_a_piece_is_cut_only_if_no_sequence_has_room_and_goes_to_the_cheapest():
    rng = random.Random(9)
    most = 4096
    for lengths in ([rng.choice((2500, 1900, 1300, 700, 90)) for _ in range(900)], [rng.randrange(1, 3000) for _ in range(1500)], [1, 1, 9000]):
        caps = packing.capacities(sum(lengths), most)
        used, cost = [0] * len(caps), [0.0] * len(caps)
        left = {}
        for d, at, n, s, offset in packing.assign(lengths, most, 1.0, 1 / 4096):
            piece = (d, at // most)
            want = left.get(piece, min(most, lengths[d] - at // most * most))
            room = [i for i in range(len(caps)) if caps[i] - used[i] >= want] or [i for i in range(len(caps)) if caps[i] > used[i]]
            assert s == min(room, key=lambda i: (caps[i] != most, cost[i], i)) and n == min(want, caps[s] - used[s]) and offset == used[s]
            left[piece] = want - n
            used[s] += n
            cost[s] += n + n * n / 4096
        assert used == caps and not any(left.values())
