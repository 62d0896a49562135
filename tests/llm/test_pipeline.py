"""The pipeline against a brute-force version in plain Python, on a fixture of every case its stages decide."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from vertexloom.llm.quality import BOILERPLATE
from vertexloom.llm.queries import tokenizer_file

RNG = random.Random(7)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(n=12):
    return " ".join(f"v{RNG.randrange(4000)}" for _ in range(n)) + "."


def article(n):
    return "\n".join(" ".join(sentence() for _ in range(3)) for _ in range(n))


def make():
    body, passage, long = [article(RNG.randint(2, 6)) for _ in range(24)], " ".join(sentence() for _ in range(5)), sentence(60)
    texts = [None, "", " \n ", "too short", "a b c d e f " * 40, *body]
    texts += [body[0], body[0], body[1].replace("v", "V"), body[2] + " " + "tail."]
    texts += [f"{article(2)}\n{passage}\n{article(1)}", f"{article(1)}\n{passage} {sentence()}", passage]
    texts += [f"{article(1)}\n{long}", f"{article(1)}\n{long[:-1]}x.\n{article(1)}"]
    texts += [f"{body[5][:300]}\nClick here | Home | About | Contact | More\n{article(1)}\nAll rights reserved"]
    texts += ["\n".join(["home | about | news | contact | help"] * 3 + [f"click here {i} {sentence(6)}" for i in range(9)] + ["one two three."])]
    texts += ["!! ## $$ %% " * 20 + sentence(), "\n".join(sentence(10) for _ in range(700)), "€ éé 日本 " + article(2)]
    return [(i, t, None, ("s1", "s2", "s1", None, "s3")[i % 5], None) for i, t in enumerate(texts)]


def found(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def line_goes(line):
    w, low = found(line), line.lower()
    seps = sum(x in ("|", "»", ">", "•", "/", "·") for x in w)
    return bool(w) and (
        10 * sum(c in "#*$%&|<>" for c in line) > len(line)
        or (len(w) >= 4 and 2 * sum(c in "!?" for c in line) > len(w))
        or (seps >= 3 and 5 * seps > len(w))
        or (len(w) < 40 and any(re.search("(?<![a-z])" + re.escape(p), low) for p in BOILERPLATE))
        or (len(w) < 12 and not re.search(r"""[.!?…:;,。！？]["'»”’)\]]*[\x20\x09-\x0D]*$""", line[-8:]))
    )


def cleaned(text):
    w = found(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    if len(w) < 10 or 100 * len(repeated) > 20 * len(w):
        return None
    left = "\n".join(x for x in text.split("\n") if not line_goes(x))
    return left if 2 * len("".join(found(left))) >= len("".join(w)) else None


def groups(sets, num, den):
    """Class of each set, linked at |intersection| / |union| >= num / den: the smallest key reachable."""
    top = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                old, new = max(top[a], top[b]), min(top[a], top[b])
                top = {k: new if t == old else t for k, t in top.items()}
    return top


def shingled(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def shared_runs(docs):
    """Words of a document that an earlier one holds in a run of 51 words or more."""
    at = defaultdict(list)
    for i in sorted(docs):
        w = [x.lower() for x in found(docs[i])]
        for k in range(len(w) - 50):
            at[tuple(w[k : k + 51])].append((i, k))
    return {(i, k + j) for places in at.values() for i, k in places if i > places[0][0] for j in range(51)}


def without_passages(docs):
    spans = {i: list(re.finditer(r"[^\x20\x09-\x0D]+", t)) for i, t in docs.items()}
    lines = {}
    for i, ms in spans.items():
        for k, m in enumerate(ms):
            lines.setdefault((i, docs[i].count("\n", 0, m.start())), []).append(k)
    content = {(i, ks[0]): tuple(spans[i][k].group().lower() for k in ks) for (i, _), ks in lines.items() if len(ks) >= 5}
    kind = groups({c: shingled(c) for c in set(content.values())}, 4, 5)
    held = defaultdict(list)
    for place in sorted(content):
        held[kind[content[place]]].append(place)
    gone = shared_runs(docs)
    gone |= {(i, k + j) for places in held.values() for i, k in places if i > places[0][0] for j in range(len(content[i, k]))}
    out = {}
    for i, ms in spans.items():
        runs = []
        for k in range(len(ms)):
            if (i, k) in gone:
                if runs and runs[-1][1] == k:
                    runs[-1][1] = k + 1
                else:
                    runs.append([k, k + 1])
        runs = [r for r in runs if r[1] - r[0] >= 51]
        text, at = "", 0
        for a, b in runs:
            text += docs[i][at : ms[a].start()]
            at = ms[b].start() if b < len(ms) else len(docs[i])
        text = (text + docs[i][at:]).rstrip(" \t\n\x0b\x0c\r") if runs else docs[i]
        if sum(b - a for a, b in runs) < len(ms):
            out[i] = text
    return out


def copies(docs, source):
    size = {i: len(found(t)) for i, t in docs.items()}
    total = Counter()
    for i in docs:
        total[source[i]] += size[i]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    left, free, target = 1.5 * sum(total.values()), set(total), {}
    while over := {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * total[s]}:
        target |= {s: 2 * total[s] for s in over}
        left, free = left - sum(2 * total[s] for s in over), free - over
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    out, begins = Counter(), Counter()
    for i in sorted(docs, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
        s = source[i]
        epochs, rest = divmod(int(target[s] + 0.5), total[s])
        taken = epochs * size[i] + max(0, min(size[i], rest - begins[s]))
        begins[s] += size[i]
        out[i] = int(taken / size[i] + 0.5)
    return out


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    rows, at = make(), str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    return rows, corpus_pipeline.run(spark, at).collect()


def test_equals_brute_force(result):
    from tokenizers import Tokenizer

    rows, got = result
    docs = {i: c for i, t, *_ in rows if (c := cleaned(t)) is not None}
    assert {0, 1, 2, 3, 4}.isdisjoint(docs) and len(docs) < len(rows) - 5 and any(docs[i] != rows[i][1] for i in docs)
    top = groups({i: shingled([w.lower() for w in found(t)]) for i, t in docs.items()}, 80, 100)
    single = {i: t for i, t in docs.items() if top[i] == i}
    assert len(single) == len(docs) - 4
    unique = without_passages(single)
    assert len(unique) == len(single) - 1 and sum(unique[i] != single[i] for i in unique) == 3
    times = copies(unique, {r[0]: r[3] for r in rows})
    bpe, expected = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), Counter()
    for i, text in unique.items():
        ids = [*bpe.encode(text, add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            expected[i, k, a, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += times[i]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +expected


def test_sequences(result):
    held = defaultdict(list)
    for r in result[1]:
        held[r.sequence_id].append(r)
    for rows in held.values():
        ends = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == ends
            ends += r.length
        assert ends <= 4096
    assert len(held) <= -(-sum(r.length for r in result[1]) // 4096) + 1


def test_empty_and_null(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    text = article(2)
    rows = [(None, text, None, None, None), (None, None, None, None, None), (9, text, "x", None, 5), (9, text, "x", None, 5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/nulls/documents.parquet")
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").count() == 3
    clash = [c for c in ("kept", "n_words", "rest", "doc", "row", "cid", "leaf", "component_id")]
    more = spark.createDataFrame([(*r, *clash) for r in rows], SCHEMA + "".join(f", {c} string" for c in clash))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, more, "").write.parquet(f"{tmp_path}/clash-{name}")
        more = spark.read.parquet(f"{tmp_path}/clash-{name}")
        assert more.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") + clash, name
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/nulls").collect()} <= {None, 9}
