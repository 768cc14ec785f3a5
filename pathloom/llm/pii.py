"""Personal information in free text: where it is, and the text with placeholders instead.

Protected entities that have forms of their own (mail addresses, phone numbers, identity numbers,
street addresses) are found by these.  What other words disclose about them and about the
persons behind them is estimated from their co-occurrence over the whole corpus:

* a given name: how many bits its occurrence in a document says about a mail address in the
  document being made of it, or how much of its occurrences stand before known surnames;
* a surname: how much of its occurrences stand with a given name or a title, or with an initial
  where the word also says enough about protected entities close by (or, for words too rare to
  tell, how much of the occurrences of words with its ending do).

A span is a name if its words exceed the thresholds.  In sanitised text, words that exceed
them but stand alone are generalised too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.pii_patterns import EMAIL, PLAIN_TITLES, TITLES, TOKEN, Places, flat, folds, mail_words, name_candidates, pattern_spans
from pathloom.operators.staging import Stages, broadcast_if_small

#: Bits about mail addresses from which a word counts as a given name, and the share of the
#: documents with the word in which it must be part of one.
GIVEN_BITS, GIVEN_SHARE = 2.0, 0.03
#: Bits that a word's occurrences say about a protected entity within so many characters, from
#: which an initial before the word counts as a person.
NEAR_BITS, NEAR_REACH = 1.0, 80
#: Documents in which a word must stand behind a title for that to count.
TITLED_DOCS = 2
#: The share of a word's occurrences before another name from which it can be a given name, and
#: before a known surname from which it is one.
GIVEN_BEFORE, GIVEN_AHEAD = 0.3, 0.5
#: The share of a surname's occurrences that stand with a given name; of all words with its
#: ending; letters of an ending and words from which its share is used.
SURNAME_SHARE, ENDING_SHARE, ENDING, ENDING_WORDS = 0.2, 0.4, 4, 5
#: Disclosing words that are sent to every task to rewrite texts.
TERMS_AT_ONCE = 500_000
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[NAME]", "name_part": "[NAME]"}

_SCAN = pa.schema([("rec", pa.string()), ("doc_id", pa.int64()), ("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("given", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64()), ("both", pa.int64()), ("near", pa.int64())])
_SCAN_DDL = "rec string, doc_id long, kind string, a int, b int, given string, term string, n long, docs long, both long, near long"


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def scan(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One pass over the texts.  ``rec`` is span (kind, a, b), name (kind is the shape; given,
    term), word (term: n occurrences, in docs documents, in both it and a mail address made of
    it, near ones close to a protected entity), mail (term: docs with such an address) or text (n
    documents, docs words, near words close to an entity).  Counts are added up in each batch
    first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            n, docs, both, near, mails, texts = Counter(), Counter(), Counter(), Counter(), Counter(), 0
            for i, given_text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                texts += 1
                if not given_text:
                    continue
                t = flat(given_text)
                spans = pattern_spans(t)
                rows += [("span", i, k, a, b, None, None, None, None, None, None) for k, a, b in spans]
                rows += [("name", i, k, a, b, g, s, None, None, None, None) for k, a, b, g, s in name_candidates(t, spans)]
                parts: set[str] = set()
                for k, a, b in spans:
                    if k == "email" and (m := EMAIL.match(t, a)):
                        parts |= mail_words(m[1])
                mails.update(parts)
                here: Counter = Counter()
                if spans:
                    inside = Places((a, b) for k, a, b in spans if k == "email")
                    all_ = Places((a, b) for _, a, b in spans)
                    for m in TOKEN.finditer(t):
                        if inside.free(m.start(), m.start() + 1):
                            w = m[1].lower()
                            here[w] += 1
                            near[w] += all_.near(*m.span(1), NEAR_REACH)
                else:
                    here.update(map(str.lower, TOKEN.findall(t)))
                n.update(here)
                docs.update(here.keys())
                if parts:
                    both.update(w for w in here if any(f in parts for f in folds(w)))
            rows += [("word", None, None, None, None, None, w, c, docs[w], both[w], near[w]) for w, c in n.items()]
            rows += [("mail", None, None, None, None, None, w, None, c, None, None) for w, c in mails.items()]
            rows.append(("text", None, None, None, None, None, None, texts, n.total(), None, near.total()))
            yield _columns(rows, _SCAN)

    slim = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, _SCAN_DDL)


def _folded(term) -> list:  # as folds(): one of the two forms is enough for the expected number
    plain = F.translate(F.lower(term), "áàâäãåéèêëíìîïóòôöõøúùûüñçýÿ'-", "aaaaaaeeeeiiiioooooouuuuncyy")
    gone = F.regexp_replace(F.lower(term), r"[^\x00-\x7f]|['-]", "")
    return [plain, gone]


def disclosure(scanned: DataFrame, stages: Stages) -> DataFrame:
    """What words disclose: (term, given, surname), booleans; only words for which one holds."""
    sums = scanned.where("rec = 'text'").agg(F.sum("n").alias("texts"), F.sum("docs").alias("words"), F.sum("near").alias("near")).first()
    total = sums["texts"] or 0
    words = scanned.where("rec = 'word'").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n", "docs", "both", "near")])
    usual = (sums["near"] or 0) / max(sums["words"] or 0, 1)
    words = stages.put(words.withColumn("near_bits", F.log2(F.col("near") / F.col("n") / F.lit(max(usual, 1e-12)))).drop("near"), "words")
    mails = scanned.where("rec = 'mail'").groupBy("term").agg(F.sum("docs").alias("mails"))
    seen = words.where("both > 0")
    for c, fold in zip(("m0", "m1"), _folded(F.col("term"))):
        seen = seen.withColumn(f"_{c}", fold).join(mails.select(F.col("term").alias(f"_{c}"), F.col("mails").alias(c)), f"_{c}", "left")
    expected = F.greatest(F.coalesce("m0", F.lit(0)), F.coalesce("m1", F.lit(0)), F.lit(1))
    bits = F.log2(F.col("both") * F.lit(float(max(total, 1))) / (F.col("docs") * expected))
    telling = seen.where((bits >= GIVEN_BITS) & (F.col("both") >= F.col("docs") * GIVEN_SHARE)).select("term")
    names = scanned.where("rec = 'name' AND kind IN ('full', 'turned') AND given <> ''").select("given", "term", "kind")
    single = scanned.where("rec = 'name' AND kind IN ('titled', 'short')").groupBy("term").agg(
        F.count_if(F.col("given").isin(*PLAIN_TITLES)).alias("titled"), F.count_distinct(F.when(F.col("given").isin(*PLAIN_TITLES), F.col("doc_id"))).alias("titled_docs"), F.count_if(F.col("kind") == "short").alias("short")
    )
    single = stages.put(single.join(words.select("term", "near_bits"), "term").select(
        "term",
        (F.when(F.col("titled_docs") >= TITLED_DOCS, F.col("titled")).otherwise(0) + F.when(F.col("near_bits") >= NEAR_BITS, F.col("short")).otherwise(0)).alias("single"),
    ).where("single > 0"), "single")
    # given names stand before other words more than behind given ones; surnames the other way
    firsts = names.where("kind = 'full'").groupBy(F.col("given").alias("term")).agg(F.count(F.lit(1)).alias("before"))
    seconds = names.join(broadcast_if_small(telling.withColumnRenamed("term", "given")), "given").groupBy("term").agg(F.count(F.lit(1)).alias("behind"))
    placed = telling.join(firsts, "term").join(words.select("term", "n"), "term").join(seconds, "term", "left")
    given = stages.put(placed.where((F.col("before") > F.coalesce("behind", F.lit(0))) & (F.col("before") >= F.col("n") * GIVEN_BEFORE)).select("term"), "given")
    found = _surnames(words, names, single, given, stages)
    # words that mostly stand before a surname, of several, are given names too
    firm = found.where("surname").select("term")
    ahead = names.where("kind = 'full'").join(broadcast_if_small(firm), "term").groupBy(F.col("given").alias("first")).agg(F.count(F.lit(1)).alias("ahead"), F.count_distinct("term").alias("of"))
    more = ahead.join(words.select(F.col("term").alias("first"), "n"), "first").where((F.col("of") >= 2) & (F.col("ahead") >= F.col("n") * GIVEN_AHEAD)).select(F.col("first").alias("term"))
    titles = [t.lower() for t in TITLES.split("|")]  # they stand before surnames, but name nobody
    all_given = stages.put(given.unionByName(more).distinct().where(~F.col("term").isin(*titles)), "given")
    return _surnames(words, names, single, all_given, stages).where("given OR surname")


def _surnames(words: DataFrame, names: DataFrame, single: DataFrame, given: DataFrame, stages: Stages) -> DataFrame:
    """(term, given, surname) of all words, by the given names that they stand with, and by titles
    and initials (``single``)."""
    stood = names.join(broadcast_if_small(given.withColumnRenamed("term", "given")), "given").groupBy("term").agg(F.count(F.lit(1)).alias("stood"))
    counted = words.select("term", "n", F.right(F.col("term"), F.lit(ENDING)).alias("ending")).join(stood, "term", "left").join(single, "term", "left").join(given.withColumn("is_given", F.lit(True)), "term", "left")
    counted = stages.put(counted.select("term", "ending", "n", (F.coalesce("stood", F.lit(0)) + F.coalesce("single", F.lit(0))).alias("stood"), F.coalesce("is_given", F.lit(False)).alias("given")), "counted")
    endings = counted.where("NOT given").groupBy("ending").agg((F.sum("stood") / F.sum("n")).alias("share"), F.count_if(F.col("stood") > 0).alias("words"))
    own = F.col("stood") >= F.greatest(F.lit(1), F.col("n") * SURNAME_SHARE)
    # a prefixed or double name is one if its last part without prefix is
    alone = counted.where(own & ~F.col("given")).select(F.col("term").alias("base"), F.lit(True).alias("base_is"))
    counted = counted.withColumn("base", F.regexp_replace(F.regexp_replace("term", "^.*-", ""), "^(o'|d'|mc|mac)", ""))
    both = counted.join(endings, "ending", "left").join(alone, "base", "left")
    like = (F.col("share") >= ENDING_SHARE) & (F.col("words") >= ENDING_WORDS)
    enough = F.coalesce(own | like | (F.col("base_is") & (F.col("base") != F.col("term"))), F.lit(False))
    return stages.put(both.select("term", "given", (enough & ~F.col("given")).alias("surname")), "disclosing")


_ORDER = {"full": 0, "short": 1, "turned": 2, "titled": 3}


def _resolve(spans: Iterable[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Accepted names (shape, a, b) of one document without overlaps: full names first, then shorter shapes."""
    out = Places()
    for _, a, b in sorted(spans, key=lambda s: (_ORDER[s[0]], s[1], -s[2])):
        if out.free(a, b):
            out.add(a, b)
    return list(zip(out.starts, out.ends))


_FOUND = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())])


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, "person_name", a, b) for i, spans in zip(batch["doc_id"].to_pylist(), batch["spans"].to_pylist()) for a, b in _resolve((s["kind"], s["a"], s["b"]) for s in spans)]
        yield _columns(rows, _FOUND)


def _locate(scanned: DataFrame, terms: DataFrame) -> DataFrame:
    known = broadcast_if_small(terms)
    named = scanned.where("rec = 'name'").select("doc_id", "kind", "a", "b", "given", "term")
    named = named.join(known.select("term", "surname").where("surname"), "term")
    firsts = known.where("given").select(F.col("term").alias("given"), F.lit(True).alias("is_given"))
    sure = named.join(firsts, "given", "left").where("is_given OR given = '' OR kind = 'titled'").select("doc_id", "kind", "a", "b")
    # all spans of one document: bounded by its length
    names = sure.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "a", "b")).alias("spans")).mapInArrow(_resolved, "doc_id long, kind string, a int, b int")
    return scanned.where("rec = 'span'").select("doc_id", "kind", "a", "b").unionByName(names)


def find_personal(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Every occurrence of personal information: (doc_id, kind, start_char, end_char).

    Characters are code points, counted from 0; end is exclusive.  Null and empty texts have
    none; documents with equal ids are kept apart by nothing, so ids should be unique.  Numbers
    start behind their label, names behind a title, addresses at number or street.
    """
    stages = Stages(documents.sparkSession, "pii")
    scanned = stages.put(scan(documents, doc_id, text), "scan")
    terms = stages.put(disclosure(scanned, stages), "terms")
    stages.keep(scanned, terms)
    return _locate(scanned, terms).select("doc_id", "kind", F.col("a").alias("start_char"), F.col("b").alias("end_char"))


def _rewritten(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with placeholders; spans (kind, a, b) that overlap become one, of the first one's kind."""
    out, at, i = [], 0, 0
    spans = sorted(spans, key=lambda s: (s[1], -s[2]))
    while i < len(spans):
        kind, a, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


def _spans_of(text: str, words: dict[str, tuple[bool, bool]]) -> list[tuple[str, int, int]]:
    """Everything to replace in one text, given what words disclose: word -> (given, surname)."""
    t = flat(text)
    spans = pattern_spans(t)
    sure = [(k, a, b) for k, a, b, g, s in name_candidates(t, spans) if words.get(s, (0, 0))[1] and (g == "" or k == "titled" or words.get(g, (0, 0))[0])]
    names = [("person_name", a, b) for a, b in _resolve(sure)]
    inside = Places((a, b) for k, a, b in spans if k == "email")
    alone = [("name_part", *m.span(1)) for m in TOKEN.finditer(t) if m[1].lower() in words and inside.free(m.start(), m.start() + 1)]
    return spans + names + alone


def sanitise(documents: DataFrame, doc_id: str, text: str, limit: int = TERMS_AT_ONCE) -> DataFrame:
    """The texts with typed placeholders for personal information: (doc_id, text).

    Words that disclose a person but stand alone become ``[NAME]`` too.  Spans that overlap become
    one placeholder.  All else is kept as it is; null texts stay null.  One row per document.

    Texts are read twice and never shuffled: disclosing words go to every task if there are no
    more than ``limit``; beyond that each text is joined with those of its words that disclose.
    """
    stages = Stages(documents.sparkSession, "pii")
    scanned = stages.put(scan(documents, doc_id, text), "scan")
    terms = stages.put(disclosure(scanned, stages), "terms")
    stages.keep(terms)
    slim = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if terms.count() <= limit:
        known = documents.sparkSession.sparkContext.broadcast({r["term"]: (r["given"], r["surname"]) for r in terms.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [_rewritten(t, _spans_of(t, known.value)) if t else t for t in batch["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

        return slim.mapInArrow(run, "doc_id long, text string")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["row"].to_pylist(), batch["text"].to_pylist()):
                rows += [(k, w) for w in {w.lower() for w in TOKEN.findall(flat(t or ""))}]
            yield _columns(rows, pa.schema([("row", pa.int64()), ("term", pa.string())]))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_rewritten(t, _spans_of(t, {w["term"]: (w["given"], w["surname"]) for w in ws or ()})) if t else t for t, ws in zip(batch["text"].to_pylist(), batch["words"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = stages.put(slim.withColumn("row", F.monotonically_increasing_id()), "texts")
    per = rows.select("row", "text").mapInArrow(words_of, "row long, term string").join(terms, "term").groupBy("row").agg(F.collect_list(F.struct("term", "given", "surname")).alias("words"))
    return rows.join(per, "row", "left").select("doc_id", "text", "words").mapInArrow(rewrite, "doc_id long, text string")
