import random
import re
import zlib
from collections import Counter

from duesight.llm import spelling
from duesight.llm.queries import op12_spelling_variants


def brute_force(docs):
    """Apart from the operator: counts by plain loops, neighbours by trying every deletion of every word."""
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    gone, holed = {}, {}
    for w in words:
        for i in range(len(w)):
            gone.setdefault(w[:i] + w[i + 1 :], set()).add(w)
            holed.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for w in words:
        for v in gone.get(w, ()):
            near[w].add(v)
            near[v].add(w)
    for group in holed.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def ran(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()),
                  key=lambda r: r[0])


def test_against_brute_force(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "Ébauche"]
    docs = []
    for key in range(400):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = base[min(int(rng.paretovariate(0.6)), len(base)) - 1]
            if rng.random() < 0.25:
                i = rng.randrange(len(w) + 1)
                w = rng.choice([w[:i] + rng.choice("abé") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abéX") + w[i + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((key, rng.choice([" ", "-", ", 7"]).join(words)))
    docs.append((400, "zyzyzya " * 5 + "zyzyzyb " * 30 + "zyzyzybc " * 200))  # a chain of two forms
    wanted = brute_force(docs)
    assert len(wanted) > 60 and any(r[1] for r in wanted) and any(r[1] != r[2] for r in wanted if r[1])
    assert ran(spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"))) == wanted


def test_the_given_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert ran(op12_spelling_variants(spark, sf_dir)) == brute_force(docs)


def test_odd_documents(spark, odd, empty):
    wanted = brute_force([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()])
    assert ran(spelling.spelling_variants(odd)) == wanted
    assert ran(spelling.spelling_variants(empty)) == []


def test_no_group_outgrows_the_alphabet(spark):
    """A prefix has one whole word and one row per letter at most, so no group needs splitting."""
    words = spark.createDataFrame([("aaaaaa", 9), ("aaaaab", 7), ("aaaaaÿ", 5), ("aaaaaaa", 50)], "word string, n long")
    groups = spelling.rotations(words).groupBy("prefix", "letter").count()
    assert groups.where("count > 1").isEmpty()
    got = {r["word"]: (r["n_near"], tuple(r["near"])) for r in spelling.neighbours(words).collect()}
    assert got["aaaaaa"] == (3, (50, "aaaaaaa")) and got["aaaaab"][0] == 2
