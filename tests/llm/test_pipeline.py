import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from lectern.llm.fertility import BANDS, measures
from lectern.llm.mixing import mix
from lectern.llm.secret_scan import Scanner
from lectern.llm.vocabulary import ByteBpe, loaded

from .test_operators import BASE, brute_repeats, corpus, shingle_sets


def good(text, lang):
    """The base rules and the outer limits; a corpus this small has no fences."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if len(words) < 20 or 100 * brute_repeats(words) > 30 * len(words):
        return False
    *_, tokens, chars, in_bytes, entropy, script = measures("piece_bpe_32k.model")(text.encode())
    band = BANDS.get(lang) or BANDS.get(script) or BANDS[""]
    return band.least_chars <= chars <= band.most_chars and in_bytes <= band.most_bytes and entropy >= band.least_entropy * np.log2(max(tokens, 2))


def redacted(text):
    """The base kinds by regular expressions; overlapping ones by the first."""
    found = sorted((m.start(), k, m.end(), name) for k, (name, p, least) in enumerate(BASE) for m in p.finditer(text) if len(m[m.re.groups] if m.re.groups else m[0]) >= least)
    out, done = [], 0
    for start, _, end, name in found:
        if start >= done:
            out += [text[done:start], f"<{name}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


def test_run_against_brute_force(spark, tmp_path):
    rows = [r[:5] for r in corpus(160, 8)]
    rows += [(900 + k, r[1] + f" password=abcdefgh{k} end", "en", "a", 0) for k, r in enumerate(corpus(24, 77)[-16:]) if r[1]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    kept = {i: (t, s) for i, t, lang, s, _ in rows if good(t, lang)}
    sets = shingle_sets([(i, t) for i, (t, _) in kept.items()])
    low = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in low:
                low[x] = i
                todo += [j for j in sets if 5 * len(sets[x] & sets[j]) >= 4 * len(sets[x] | sets[j])]
    kept = {i: (redacted(t), s) for i, (t, s) in kept.items() if low[i] == i}
    assert any("<assign>" in t for t, _ in kept.values()) and len(kept) > 40

    pieces = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    bpe = loaded(ByteBpe, "byte_bpe_50k.json")
    ids = {i: np.append(np.frombuffer(bpe.whole(t), dtype="<u4"), np.uint32(1)).astype("<u4") for i, (t, _) in kept.items()}
    size = {i: len(t.split()) for i, (t, _) in kept.items()}
    # copies: whole parts for sure, and source by source as many words as the targets say, but for one document
    copies = Counter(p.doc_id for p in pieces if p.start == 0)
    frame = spark.createDataFrame([(i, t, s) for i, (t, s) in kept.items()], "doc_id long, text string, source string")
    due = {r.doc_id: (r.target, r.source_size) for r in mix(frame).collect()}
    for i in kept:
        assert 0 <= copies[i] - int(due[i][0] / due[i][1] + 1e-9) <= 1
    for s in {s for _, s in kept.values()}:
        own = [i for i in kept if kept[i][1] == s]
        assert abs(sum(copies[i] * size[i] for i in own) - due[own[0]][0]) <= max(size[i] for i in own)
    assert set(copies) <= set(kept)
    # every copy's ids lie in exactly one piece each, and sequences are gapless and full but one
    covered = Counter()
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        covered.update((p.doc_id, k) for k in range(p.start, p.start + p.length))
    assert covered == {(i, k): copies[i] for i in copies for k in range(len(ids[i]))}
    filled = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled.get(p.sequence_id, 0)
        filled[p.sequence_id] = p.offset + p.length
    assert sum(n < 2048 for n in filled.values()) <= 1 and max(filled.values()) <= 2048


def test_stages(spark):
    rows = corpus(200, 8)
    rows.append((900, rows[-1][1] + " password=abcdefgh1234 end", "en", "a", 0, 7, "x"))
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, "").cache()
        assert kept.columns == docs.columns, name
        ids, old = [r.doc_id for r in kept.collect()], {r.doc_id: r.text for r in before.collect()}
        assert set(ids) <= set(old)
        if name == "secret scans":
            assert len(ids) == len(old)
            for r in kept.collect():
                assert not Scanner().find(r.text.encode()) and r.n_chars == len(r.text)
    assert {p.doc_id for p in corpus_pipeline.STAGES[-1][1](spark, kept, "").collect()} == {r.doc_id for r in kept.collect()}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_contract_columns(spark):
    from lectern.llm.queries import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and [n.split("_")[0] for n in QUERIES if n.startswith("op")] == [f"op{k}" for k in range(1, 11)]
