"""The found queries that SQL can't express, over the smallest tables, against plain Python."""

import base64
import itertools
import unicodedata
from collections import defaultdict
from pathlib import Path

import pytest

from corpusloom.llm import bpe, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
# the truth of the test is written down here, not taken from the module
LOOK_ALIKE = {
    "CYRILLIC SMALL LETTER": {"A": "a", "IE": "e", "O": "o", "ER": "p", "ES": "c", "HA": "x", "U": "y", "BYELORUSSIAN-UKRAINIAN I": "i", "JE": "j", "DZE": "s"},
    "CYRILLIC CAPITAL LETTER": {
        "A": "A", "VE": "B", "IE": "E", "KA": "K", "EM": "M", "EN": "H", "O": "O", "ER": "P", "ES": "C", "TE": "T", "HA": "X", "U": "Y",
        "BYELORUSSIAN-UKRAINIAN I": "I", "JE": "J", "DZE": "S",
    },
    "GREEK CAPITAL LETTER": {
        "ALPHA": "A", "BETA": "B", "EPSILON": "E", "ZETA": "Z", "ETA": "H", "IOTA": "I", "KAPPA": "K", "MU": "M", "NU": "N", "OMICRON": "O", "RHO": "P",
        "TAU": "T", "UPSILON": "Y", "CHI": "X",
    },
    "GREEK SMALL LETTER": {"OMICRON": "o", "NU": "v"},
    "ARMENIAN SMALL LETTER": {"OH": "o", "SEH": "u"},
}
LATIN = {unicodedata.lookup(f"{kind} {name}"): latin for kind, names in LOOK_ALIKE.items() for name, latin in names.items()}
FILLERS = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0}


def unseen(c):
    """Format and control characters without ink, selectors and fillers."""
    n = ord(c)
    if unicodedata.category(c) in ("Cf", "Cc"):
        return c not in "\t\n\v\f\r\x85" and not 0x600 <= n <= 0x605 and n != 0x6DD
    return n in FILLERS or 0xFE00 <= n <= 0xFE0F or 0x180B <= n <= 0x180F or 0xE0100 <= n <= 0xE01EF


def shown(text):
    """The line as a reader sees it, character by character."""
    out = []
    kept = [c for c in text if not unseen(c) or c == chr(0x200D)]
    emoji = lambda c: unicodedata.category(c) == "So"
    for i, c in enumerate(kept):
        if c == chr(0x200D):
            if 0 < i < len(kept) - 1 and emoji(kept[i - 1]) and emoji(kept[i + 1]):
                out.append(c)
        elif unicodedata.category(c) == "Zs":
            out.append(" ")
        elif unicodedata.decomposition(c).startswith(("<wide>", "<initial>", "<medial>", "<final>", "<isolated>")):
            out.append(unicodedata.normalize("NFKC", c))
        else:
            out.append(c)
    line = unicodedata.normalize("NFD", "".join(out))
    line = "".join(LATIN.get(c, c) for c in line)
    result = list(line)
    for i, c in enumerate(line):
        if ord(c) in (0x6A9, 0x6CC):
            after = next((x for x in line[i + 1 :] if unicodedata.category(x) != "Mn"), "")
            joins = bool(after) and unicodedata.category(after)[0] == "L" and "ARABIC" in unicodedata.name(after, "")
            result[i] = {(0x6A9, True): chr(0x643), (0x6CC, True): chr(0x64A), (0x6CC, False): chr(0x649)}.get((ord(c), joins), c)
    return unicodedata.normalize("NFC", "".join(result))


def test_lines_that_look_the_same(spark, rows):
    want = set()
    for name, column in (("interim_dataset", "text"), ("ood_leakage_precheck", "original_text")):
        lines = defaultdict(list)
        for r in spark.read.parquet(f"{DATA}/{name}.parquet").select("record_id", column).collect():
            if r[1] and any(unicodedata.category(c)[0] in "LN" for c in r[1]):
                lines[shown(r[1])].append((r[0], r[1]))
        for group in lines.values():
            want |= {(min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(group, 2) if x != y}
    got = rows(queries.p6_found(spark, str(DATA)))
    assert want and len(got) == len(set(got)) and set(got) == want


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.load().splitlines())}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_sources(spark, public):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "text").collect()
    ids = {r.doc_id: public.encode_ordinary(r.text or "") for r in docs}
    assert {r.doc_id: r.ids for r in queries.p7_ids(spark, str(DATA)).collect()} == ids
    own = defaultdict(int)
    for r in docs:
        own[r.source] += len(ids[r.doc_id])
    targets = spark.read.parquet(f"{DATA}/mix_targets.parquet").collect()
    total = sum(own[t.source] for t in targets)
    unmet = {t.source for t in targets if t.max_repeats * own[t.source] < t.weight * total}
    assert {r.source for r in queries.p8_found(spark, str(DATA)).collect()} == unmet


def test_shares_follow_the_targets(spark, public):
    rows = queries.p8_shares(spark, str(DATA)).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("source", "text").collect()
    longest = {r.source: 0 for r in rows}
    for d in docs:
        if d.source in longest:
            longest[d.source] = max(longest[d.source], len(public.encode_ordinary(d.text or "")))
    free = [r for r in rows if not r.unmet and r.mixed_tokens < r.max_repeats * r.own_tokens]
    rate = sum(r.solved_tokens for r in free) / sum(r.weight for r in free)
    for r in rows:
        assert abs(r.mixed_tokens - r.solved_tokens) <= longest[r.source]  # one document
        assert r.solved_tokens <= r.max_repeats * r.own_tokens + 1e-6
    assert all(abs(r.solved_tokens - r.weight * rate) < 1e-3 for r in free)
    assert abs(sum(r.solved_tokens for r in rows) - min(sum(r.own_tokens for r in rows), sum(r.max_repeats * r.own_tokens for r in rows))) < 1


def test_samples_follow_the_targets(spark):
    rows = queries.p5_report(spark, str(DATA)).collect()
    n_all = spark.read.parquet(f"{DATA}/interim_dataset.parquet").count()
    asked = {(r.target_name, r.category): r for r in spark.read.parquet(f"{DATA}/sample_targets.parquet").collect()}
    assert len(rows) == len(asked)
    assert all(r.drawn_rows >= min(r.min_rows, r.n_rows) for r in rows)
    for name in {r.target_name for r in rows}:
        own = [r for r in rows if r.target_name == name]
        size = sum(asked[name, r.category].target_share for r in own) * asked[name, own[0].category].sample_fraction * n_all
        floors = sum(min(r.min_rows, r.n_rows) for r in own)
        assert abs(sum(r.drawn_rows for r in own) - max(floors, min(size, sum(r.n_rows for r in own)))) <= 1
        free = [r for r in own if r.min_rows < r.drawn_rows < r.n_rows and r.target_share > 0]
        rates = [r.drawn_rows / r.target_share for r in free]
        slack = [2 / r.target_share for r in free]
        assert all(abs(a - b) <= s + z for a, s in zip(rates, slack, strict=True) for b, z in zip(rates, slack, strict=True))
