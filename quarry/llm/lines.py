"""Line dedup by a segment-partition edit join.

A line is dropped if an equal line, or one within ``tau`` edits, comes before
it (by document id, then row, then line number; lines are compared without
ASCII white space at their ends, blank lines are left alone).

1. Equal lines collapse on a 128-bit hash; the first occurrence stands for all.
2. A line of ``min_chars`` or more is split into tau + 1 segments.  Of two
   lines within tau edits one segment of the longer occurs in the shorter, at
   a place and for a length that the length difference bounds: the longer one
   indexes its segments by (length, number, text), the shorter one probes the
   substrings that may meet them.  Lines that share no key with another line
   end here; only the others' texts are fetched.
3. A key that more than ``HOT`` lines share (a passage with many variants) is
   split further instead of comparing all its lines: for tau = 1 the edit lies
   in the other half, which is cut into pieces; two lines within one edit agree
   on all of it but one piece.  Where that is still hot, the pieces are single
   characters; lines that then share a key are all within one edit of each
   other, so each is linked with the first of them.  Nothing is capped.
4. Pairs are verified by a banded bit-parallel edit distance (Hyyro): one
   64-bit word holds the band of a column, columns are folded one by one.

Only DataFrame and SQL functions are used.

Scale.  Steps 1 and 2 shuffle hashes, not texts.  The dropped lines' positions
are joined to the documents at the end, the one shuffle that carries all text
(and a second one in step 2 where the documents that hold candidates are too
many to be broadcast).

Defined cases: null texts stay null, empty texts empty; repeated rows are
copies (the first keeps its lines); a row that loses all its lines keeps its
blank rest (``dedup_lines`` can drop it); an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import fresh, sized, stored, with_uid, written

TAU = 1
MIN_CHARS = 32
HOT = 64
PIECES = 8  # of the half that holds the edit
BLANK = " \t\x0b\x0c\r"
TOP = 60  # highest bit of the band's word (no sum leaves 63 bits)


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """0-based start and width of segment i: the last ones are one longer."""
    w = F.floor(length / parts)
    extra = length % parts
    longer = F.greatest(F.lit(0), F.lit(i) - (F.lit(parts) - extra))
    width = w + F.when(F.lit(i) >= F.lit(parts) - extra, 1).otherwise(0)
    return (w * i + longer).cast("int"), width.cast("int")


def _sub(line: Column, start: Column, width: Column) -> Column:
    return F.substring(line, (start + 1).cast("int"), width.cast("int"))


def segment_keys(line: Column, length: Column, tau: int) -> tuple[Column, Column]:
    """(own keys, probe keys): hashes of (indexed length, segment, text)."""
    own, probe = [], []
    for i in range(tau + 1):
        p, w = _segment(length, i, tau + 1)
        for shift in range(-min(i, tau - i), min(i, tau - i) + 1):
            key = F.xxhash64(length, F.lit(i), _sub(line, p + shift, w))
            (own if shift == 0 else probe).append(key)
        for d in range(1, tau + 1):
            p, w = _segment(length + d, i, tau + 1)
            for shift in range(max(-i, -d - (tau - i)), min(i, -d + (tau - i)) + 1):
                probe.append(F.xxhash64(length + d, F.lit(i), _sub(line, p + shift, w)))
    return F.array(*own), F.array_distinct(F.array(*probe))


def piece_keys(line: Column, length: Column, own_length: Column, pieces: int, halves: tuple[int, ...] = (0, 1)) -> Column:
    """Keys of a line against lines of ``length`` (its own, or one more) for
    tau = 1: everything but one piece of the half that is not ``half``
    (``pieces`` 0: pieces of one character)."""
    def keys(half: int) -> Column:
        a, w = _segment(length, 1 - half, 2)
        n = F.lit(pieces) if pieces else w

        def key(q):
            lo, hi = a + F.floor(q * w / n).cast("int"), a + F.floor((q + 1) * w / n).cast("int")
            rest = (length - hi).cast("int")
            return F.xxhash64(length, F.lit(half), q, _sub(line, F.lit(0), lo), _sub(line, own_length - rest, rest))

        return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), key)

    return F.concat(*[keys(h) for h in halves])


def _band(a: Column, b: Column, tau: int) -> tuple[Column, str]:
    """(pair, expression over ``__pair``): the edit distance of two lines
    (lengths differ by at most tau, both longer than tau), exact up to tau,
    else larger.  The band's 2 tau + 1 cells of a
    column sit in the top bits of a word that moves down the diagonal."""
    la, lb = F.char_length(a), F.char_length(b)
    swap = la < lb
    first, second = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    state = F.struct(F.encode(first, "UTF-32").alias("x"), F.encode(second, "UTF-32").alias("y"),
                     F.greatest(la, lb).alias("n"), F.least(la, lb).alias("m"))
    match = " | ".join(f"if(i + {k} >= 0 and i + {k} < p.n and substring(p.x, 4 * (i + {k}) + 1, 4) = substring(p.y, 4 * i + 1, 4), "
                       f"{1 << (TOP - tau + k)}L, 0L)" for k in range(-tau, tau + 1))
    mask, last = f"{(1 << (TOP + 1)) - 1}L", f"shiftleft(1L, {TOP} - 1 - (i - p.n + {tau}))"
    step = f"""
      transform(array({match}), pm ->
      transform(array(((((pm & s.vp) + s.vp) ^ s.vp) | pm | s.vn) & {mask}), d0 ->
      transform(array(named_struct('hp', s.vn | (~(d0 | s.vp) & {mask}), 'hn', d0 & s.vp)), h ->
        named_struct('vp', (h.hn | ~(shiftright(d0, 1) | h.hp)) & {mask}, 'vn', shiftright(d0, 1) & h.hp,
          'd', s.d + if(i < p.n - {tau}, if((d0 & {1 << TOP}L) = 0, 1, 0),
                        if((h.hp & {last}) <> 0, 1, 0) - if((h.hn & {last}) <> 0, 1, 0)))
      )[0])[0])[0]"""
    start = ((1 << (TOP + 1)) - 1) >> (TOP - tau) << (TOP - tau)
    fold = f"""transform(array(__pair), p -> aggregate(sequence(0, p.m - 1),
        named_struct('vp', {start}L, 'vn', 0L, 'd', {tau}), (s, i) -> {step}, s -> s.d))[0]"""
    return state, fold


def _distance(pairs: DataFrame, tau: int) -> DataFrame:
    state, fold = _band(F.col("line_a"), F.col("line_b"), tau)
    return pairs.withColumn("__pair", state).withColumn("edits", F.expr(fold)).drop("__pair")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also inside its lambdas."""
    return F.transform(F.array(value), use)[0]


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)))


def line_table(docs: DataFrame, id_col: str, text_col: str, tau: int, min_chars: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with uid, lines by place and hash, distinct lines with keys)."""
    src = with_uid(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    placed = (src.select("uid", "doc_id", F.posexplode(_lines(F.col("text"))).alias("line_no", "line")).where("line <> ''")
              .withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64("line", F.lit(2))))
    size = F.char_length("line")
    own, probe = segment_keys(F.col("line"), size, tau)
    none = F.array().cast("array<bigint>")
    keyed = placed.select("uid", "h1", "h2", F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "uid", "line_no").alias("ord"),
                          F.when(size >= min_chars, own).otherwise(none).alias("own"),
                          F.when(size >= min_chars, probe).otherwise(none).alias("probe"))
    distinct = written(keyed.groupBy("h1", "h2").agg(F.min("ord").alias("ord"), F.count("*").alias("n"),
                                                     F.first("own").alias("own"), F.first("probe").alias("probe")), "lines")
    return src, placed.select("uid", "doc_id", "line_no", "h1", "h2"), distinct


def _meetings(rows: DataFrame) -> DataFrame:
    """key, n of keys that an indexing line and some other line have."""
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.max("is_own").alias("has")).where("n > 1 and has").select("key", "n")


def _sides(own: Column, probe: Column) -> Column:
    return F.explode(F.concat(F.transform(own, lambda k: F.struct(k.alias("key"), F.lit(True).alias("is_own"))),
                              F.transform(probe, lambda k: F.struct(k.alias("key"), F.lit(False).alias("is_own")))))


def _pairs(rows: DataFrame, tau: int) -> DataFrame:
    """Pairs of lines with a common key of which at least one indexes it."""
    a = rows.where("is_own").select("key", *[F.col(c).alias(f"{c}_a") for c in ("h1", "h2", "ord", "line", "subs")])
    b = rows.select("key", "is_own", *[F.col(c).alias(f"{c}_b") for c in ("h1", "h2", "ord", "line", "subs")])
    ok = (~F.col("is_own") | (F.col("ord_a") < F.col("ord_b"))) & (F.col("ord_a") != F.col("ord_b"))
    if tau == 1:  # two lines within one edit agree on all but one piece
        ok = ok & F.arrays_overlap("subs_a", "subs_b")
    return b.join(a, "key").where(ok).select("h1_a", "h2_a", "ord_a", "line_a", "h1_b", "h2_b", "ord_b", "line_b").distinct()


def near_links(src: DataFrame, distinct: DataFrame, tau: int = TAU, hot: int = HOT) -> DataFrame:
    """h1_a, h2_a, ord_a, h1_b, h2_b, ord_b, edits of distinct lines within
    tau edits (of a hot clique: with its first line)."""
    cells = distinct.select("h1", "h2", "ord", _sides(F.col("own"), F.col("probe")).alias("k")).select("h1", "h2", "ord", "k.*")
    met = written(_meetings(cells), "met")
    wanted = (cells.join(met.hint("merge"), "key").select(F.col("ord.uid").alias("uid"), F.col("ord").alias("ord"), "h1", "h2").distinct()
              .groupBy("uid").agg(F.collect_list(F.struct("ord", "h1", "h2")).alias("w")))  # at most a document's lines
    wanted = written(wanted, "wanted")
    got = (src.select("uid", "text").join(sized(wanted, 400), "uid")
           .select(F.explode(_once(F.split("text", "\n", -1), lambda lines: F.transform("w", lambda x: F.struct(
               x["ord"].alias("ord"), x["h1"].alias("h1"), x["h2"].alias("h2"), F.get(lines, x["ord"]["line_no"]).alias("line"))))).alias("r"))
           .select("r.h1", "r.h2", "r.ord", F.btrim("r.line", F.lit(BLANK)).alias("line")))
    size = F.char_length("line")
    own, probe = segment_keys(F.col("line"), size, tau)
    subs = F.concat(piece_keys(F.col("line"), size, size, PIECES), piece_keys(F.col("line"), size + 1, size, PIECES)) if tau == 1 \
        else F.array().cast("array<bigint>")
    texts = written(got.withColumn("own", own).withColumn("probe", probe).withColumn("subs", subs), "texts")
    rows = texts.select("h1", "h2", "ord", "line", "subs", _sides(F.col("own"), F.col("probe")).alias("k")).select(
        "h1", "h2", "ord", "line", "subs", "k.*")
    keys = met
    if tau == 1:
        keys = met.where(F.col("n") <= hot)
    pairs = _pairs(rows.join(keys.select("key"), "key"), tau)
    if tau == 1:
        some = written(rows.join(met.where(F.col("n") > hot).select("key"), "key").select("h1", "h2", "ord", "line").distinct(), "hot")
        size = F.char_length("line")
        finer = _sides(piece_keys(F.col("line"), size, size, PIECES), piece_keys(F.col("line"), size + 1, size, PIECES))
        split = some.select("h1", "h2", "ord", "line", F.lit(None).cast("array<bigint>").alias("subs"), finer.alias("k")).select(
            "h1", "h2", "ord", "line", "subs", "k.*")
        met2 = written(_meetings(split), "met2")
        calm = split.join(met2.where(F.col("n") <= hot).select("key"), "key")
        pairs = pairs.union(_pairs(calm, 0))
        still = written(split.join(met2.where(F.col("n") > hot).select("key"), "key").select("h1", "h2", "ord", "line").distinct(), "hotter")
        single = _sides(piece_keys(F.col("line"), size, size, 0), piece_keys(F.col("line"), size + 1, size, 0))
        chars = still.select("h1", "h2", "ord", "line", single.alias("k")).select("h1", "h2", "ord", "line", "k.key")
        head = chars.groupBy("key").agg(F.min(F.struct("ord", "h1", "h2", "line")).alias("x"), F.count("*").alias("n")).where("n > 1")
        star = chars.join(head, "key").where("x.ord <> ord").select(
            F.col("x.h1").alias("h1_a"), F.col("x.h2").alias("h2_a"), F.col("x.ord").alias("ord_a"), F.col("x.line").alias("line_a"),
            F.col("h1").alias("h1_b"), F.col("h2").alias("h2_b"), F.col("ord").alias("ord_b"), F.col("line").alias("line_b")).distinct()
        pairs = pairs.union(star)
    checked = _distance(written(pairs, "pairs"), tau).where(F.col("edits") <= tau).drop("line_a", "line_b")
    return written(checked, "links")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU,
                  min_chars: int = MIN_CHARS, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(src, placed lines, drops): drops has uid and the array of dropped
    (line_no, keep_doc_id, keep_line_no, edits) of each row that loses lines."""
    src, placed, distinct = line_table(docs, id_col, text_col, tau, min_chars)
    links = near_links(src, distinct, tau, hot)
    a_first = F.col("ord_a") < F.col("ord_b")
    later = links.select(F.when(a_first, F.col("h1_b")).otherwise(F.col("h1_a")).alias("h1"),
                         F.when(a_first, F.col("h2_b")).otherwise(F.col("h2_a")).alias("h2"),
                         F.least("ord_a", "ord_b").alias("keep"), "edits")
    near = later.groupBy("h1", "h2").agg(F.min(F.struct("keep", "edits")).alias("near"))
    rules = written(distinct.select("h1", "h2", "ord", "n").join(near, ["h1", "h2"], "left").where("n > 1 or near is not null"), "rules")
    hit = placed.join(rules.hint("merge"), ["h1", "h2"])
    first = (F.col("uid") == F.col("ord.uid")) & (F.col("line_no") == F.col("ord.line_no"))
    keep = F.coalesce("near.keep", "ord")
    drops = (hit.where(~first | F.col("near").isNotNull())
             .select("uid", F.struct("line_no", keep["doc_id"].alias("keep_doc_id"), keep["line_no"].alias("keep_line_no"),
                                     F.coalesce("near.edits", F.lit(0)).alias("edits")).alias("d"))
             .groupBy("uid").agg(F.array_sort(F.collect_list("d")).alias("drops")))  # at most a document's lines
    return src, placed, written(drops, "drops")


def _kept_text(text: Column, drops: Column) -> Column:
    def kept(lines):
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(drops, lambda d: d["line_no"]))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return F.when(drops.isNull() | text.isNull(), text).otherwise(_once(F.split(text, "\n", -1), kept))


def _line_count(text: Column) -> Column:
    """Lines that are not blank: newlines and one more, unless a line starts
    with white space or is empty; those texts take the regular expression."""
    odd = F.substring(text, 1, 1).isin(*BLANK)
    for c in "\n" + BLANK:
        odd = odd | F.contains(text, F.lit("\n" + c))
    odd = odd | text.endswith("\n") | text.startswith("\n") | (text == "")
    return F.when(odd, F.regexp_count(text, F.lit(r"[^ \t\x0b\x0c\r\n][^\n]*"))).otherwise(
        F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: uid, doc_id, n_lines (not blank), n_copies,
    n_near, drops, text (without the dropped lines)."""
    src, _, drops = dropped_lines(docs, id_col, text_col, **options)
    joined = src.join(drops.hint("merge"), "uid", "left")
    gone = lambda f: F.coalesce(F.size(F.filter("drops", f)), F.lit(0)).cast("long")
    n = _line_count(F.coalesce("text", F.lit(""))).cast("long")
    return joined.select("uid", "doc_id", n.alias("n_lines"), gone(lambda d: d["edits"] == 0).alias("n_copies"),
                         gone(lambda d: d["edits"] > 0).alias("n_near"), "drops", _kept_text(F.col("text"), F.col("drops")).alias("text"))


def dedup_lines(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The rows of ``docs`` with their columns, the text without the dropped
    lines (and ``chars_col``, if there is one, counted again); rows of which
    every line is dropped go."""
    docs, uid = stored(docs), fresh(docs, "q_uid")
    _, _, drops = dropped_lines(docs, text_col=text_col, **options)
    mark = fresh(docs, "q_drops")
    joined = with_uid(docs, uid).join(drops.select(F.col("uid").alias(uid), F.col("drops").alias(mark)).hint("merge"), uid, "left")
    text = _kept_text(F.col(text_col), F.col(mark))
    changed = joined.withColumn(text_col, text)
    if chars_col and chars_col in docs.columns:
        changed = changed.withColumn(chars_col, F.when(F.col(mark).isNotNull(), F.char_length(text_col).cast(docs.schema[chars_col].dataType))
                                     .otherwise(F.col(chars_col)))
    left = F.btrim(F.col(text_col), F.lit(BLANK + "\n")) != ""
    return changed.where(F.col(mark).isNull() | left).select(*docs.columns)
