"""Noise of print and scan in page texts, found by evidence of the corpus.

One scan of the pages yields their edge lines, what could be page numbers,
words cut at line ends, and counts of words, compounds, ideographs and their
bigrams, apart for recognised and for clean pages. SQL then decides: a title
runs if it stands at the edge of several pages of a file (or is a chapter
title of it), give or take misread characters; a page number is the one that
the page's label says; a cut word is one that is known joined. Words and
pairs of ideographs that are rare but for recognised pages are joined with
frequent ones by the differences of their anagram hashes, which confusable
characters leave; the ranked corrections tell the misread lines in a second
scan of the recognised pages. Known confusions (letters, and ideographs of
like shape) rank first; a misread ideograph whose reading stays open is
reported, but not corrected.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracebook.sources.tables import stage, without_broadcast

# Characters that recognition confuses, as right and wrong.
CONFUSED = ["ec", "tf", "ao", "i1", "l1", "s5", "o0", "g9", "hb", "vy", "il", "li", "b8", "z2", "ce", "ft", "oa", "bh", "yv", "q9", "nh", "hn", "uv", "vu", "nu", "un"]
#: Of several characters: right and wrong.
CONFUSED_LONG = [("m", "rn"), ("d", "cl"), ("w", "vv"), ("h", "li"), ("u", "ii"), ("n", "ri"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("li", "h"), ("ii", "u"), ("nn", "rm"), ("ri", "n")]
# Pairs of ideographs of like shape, which recognition takes for each other.
LIKE_SHAPES = """
度席 压庄 器嚣 流硫 率卒 烟炯 管菅 墙樯 箱葙 速逑 楼搂 热執 风凤 控腔 料科 温溫 阀阏 防妨 材村 泵泉 积枳 载栽 喷愤 释译 浓侬 排徘 梯悌
未末 土士 己已 日曰 人入 干千 天夫 大太 犬太 木本 目且 白自 田由 甲申 令今 力刀 刃刀 九丸 几凡 石右 左在 王玉 玉主 午牛 户尸 毛手
折拆 析折 侯候 治冶 冷泠 拔拨 免兔 鸟乌 勾匀 处外 贝见 住往 佳住 注往 问间 问闻 阅阔 体休 抢枪 杯坏 板扳 杨扬 扬场 汤场 情清 清请 晴睛 睛精
准淮 沙纱 抄炒 钢钩 钩钓 铜钢 线钱 级极 技枝 纹纺 仿访 坊防 放故 收攻 改政 险验 检捡 脸险 峰锋 缝蓬 摸模 模漠 幕墓 慕幕 暮幕 栏拦 轮论 伦轮 输愉
燥操 澡燥 噪燥 蓝篮 监蓝 盖益 盘盆 血皿 直真 具真 晶品 圆园 国围 围困 因困 固围 回四 酒洒 晒洒 师帅 币巾 布市 冒昌 复夏 厉历 厂广 床庆 底低 抵低
代伐 状壮 璧壁 避壁 辨辩 籍藉 暑署 竟竞 遣遗 贵责 货贷 资姿 粉纷 份分 项顶 须顺 预顶 频顿 炉护 灾火 炭岩 炮炬 煤媒 爆瀑 曝爆 传转 速迷 送迭 导异 阻组 隔融 密蜜 量童 宽觉 载裁
""".split()
#: (right, wrong) of all confusions that are known, in both directions for those of like shape.
KNOWN = [(x[0], x[1]) for x in CONFUSED] + CONFUSED_LONG + [p for a, b in LIKE_SHAPES for p in ((a, b), (b, a))]
#: A pair of characters that is not known counts if it explains this share of the rare words that any pair explains.
BACKING = 0.005
#: How much more of its neighbours one reading must explain than the next for the text to be changed.
MARGIN = 2
#: Letters that stand for digits.
DIGIT_OF = str.maketrans("lIiOoZzSsBbgq|", "11100225588991"[:14])

NUMBER = r"(?:[0-9lIOoZSB]{1,4}|[ivxlc]{1,6})"
DRESS = r"[\s\-–—~·•\[\]()（）【】|*<>«»]*"
PAGE_LINE = re.compile(rf"^(?P<a>{DRESS})(?P<w>page\s+no\.?|page|pg?\.?|no\.?|第)?\s*(?P<n>{NUMBER})\s*(?:页)?\s*(?:(?:of|/|／)\s*[0-9lIOoZSB]+)?(?P<z>{DRESS})$", re.IGNORECASE)
WITH_NUMBER = (re.compile(rf"^{NUMBER}\s{{2,}}(.*)$"), re.compile(rf"^(.*?)\s{{2,}}{NUMBER}$"))
CUT = re.compile(r"([^\W\d_]+)[-‐‑­][ \t\r]*\n[ \t]*([^\W\d_]+)")
WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9]+")
COMPOUND = re.compile(r"(?<![^\W\d_])[^\W\d_㐀-鿿]++(?:-[^\W\d_㐀-鿿]++)+")
HAN = re.compile("[㐀-鿿]")
STOP_END = re.compile(r"[.,;:!?。，；：、！？]$")
LETTER = re.compile(r"[^\W\d_]")
FOUND = "kind string, file_id string, page_no int, line_no int, a string, b string, n long, m long"


#: Titles up to this length may differ by misread characters; longer ones must be equal.
LONG = 120
HASHED = "#md5:"


def core_of(line: str) -> str:
    """An edge line without its page number, blanks and letter case; one longer
    than LONG, which is the same title only as an equal line, by its hash."""
    line = line.strip()
    for way in WITH_NUMBER:
        if m := way.match(line):
            line = m[1]
            break
    core = re.sub(r"\s+", "", line).lower()
    return core if len(core) <= LONG else HASHED + hashlib.md5(core.encode("utf-8", "surrogatepass")).hexdigest()


def number_of(text: str) -> str:
    """A page number with misread digits put right; roman ones as they are."""
    return text if re.fullmatch("[ivxlc]*[ivx][ivxlc]*", text) else text.translate(DIGIT_OF)


def label_number(label: str | None) -> tuple[str | None, bool]:
    """The number of a page label, and whether a digit of it is misread."""
    if label is None:
        return None, False
    plain = re.sub(r"^(?:page|slide|pg|p|第)?[\s.]*|[\s.]*页?$", "", label.strip(), flags=re.IGNORECASE)
    if plain.isdigit() or re.fullmatch("[ivxc]+", plain) or re.fullmatch("[ivxlc]*[ivx][ivxlc]*", plain):
        return plain, False
    fixed = plain.translate(DIGIT_OF)
    return (fixed, True) if fixed.isdigit() else (plain, False)


def edges(lines: list[str]) -> tuple[list[int], list[int]]:
    """Indices of the first two and of the last two lines with text."""
    held = [i for i, x in enumerate(lines) if x.strip()]
    return held[:2], held[-2:][::-1]


def count_words(texts: list[str], words: Counter, chunk: int = 2_000) -> None:
    """Add the words of two characters or more, and the compounds, of the texts
    in lower case to the count."""
    for i in range(0, len(texts), chunk):
        joined = "\n".join(texts[i : i + chunk])
        words.update({w: n for w, n in Counter(WORD.findall(joined)).items() if len(w) > 1})
        words.update(COMPOUND.findall(joined))


def count_ideographs(texts: list[str], chars: Counter, pairs: Counter, chunk: int = 2_000) -> None:
    """Add the ideographs of the texts and the pairs of neighbours to the counts."""
    for i in range(0, len(texts), chunk):
        codes = np.frombuffer("\n".join(texts[i : i + chunk]).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
        han = (codes >= 0x3400) & (codes <= 0x9FFF)
        both = han[:-1] & han[1:]
        one, n = np.unique(codes[han], return_counts=True)
        chars.update(dict(zip(map(chr, one.tolist()), n.tolist())))
        two, n = np.unique(codes[:-1][both] << np.uint64(16) | codes[1:][both], return_counts=True)
        pairs.update({chr(k >> 16) + chr(k & 0xFFFF): v for k, v in zip(two.tolist(), n.tolist())})


def _survey(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out: list[tuple] = []
        counts = {"word": (Counter(), Counter()), "han": (Counter(), Counter()), "char": (Counter(), Counter())}
        chinese: tuple[list[str], list[str]] = [], []
        plain: tuple[list[str], list[str]] = [], []
        for file_id, page_no, text, ocr in zip(f["file_id"], f["page_no"], f["text"], f["ocr"]):
            lines = text.split("\n")
            seen = set()
            for side in edges(lines):
                for k, i in enumerate(side):
                    x = lines[i].strip()
                    if i in seen:
                        continue
                    if m := PAGE_LINE.match(x):
                        out.append(("num", file_id, page_no, i + 1, number_of(m["n"]), "dressed" if m["w"] or m["a"] or m["z"] or len(m["n"]) < len(x) else "bare", 0, 0))
                        seen.add(i)
                    elif k == 0 or PAGE_LINE.match(lines[side[0]].strip()):
                        c = core_of(x)
                        if len(c) >= 3 and LETTER.search(c) and not STOP_END.search(c):
                            out.append(("edge", file_id, page_no, i + 1, c, None, 0, 0))
                            seen.add(i)
            if "-\n" in text or "‐" in text or "‑" in text or "­" in text or "- " in text:
                for m in CUT.finditer(text):
                    if m[2][0].islower():
                        out.append(("cut", file_id, page_no, text.count("\n", 0, m.start()) + 1, (m[1] + m[2]).lower(), f"{m[1]}-{m[2]}".lower(), len(m[1]), int(ocr)))
                text = CUT.sub(" ", text)
            plain[ocr].append(text.lower())
            if HAN.search(text):
                chinese[ocr].append(text.replace("\n", ""))
        for ocr in (False, True):
            count_words(plain[ocr], counts["word"][ocr])
            count_ideographs(chinese[ocr], counts["char"][ocr], counts["han"][ocr])
        for kind, (clean, read) in counts.items():
            for key in clean.keys() | read.keys():
                out.append((kind, None, None, None, key, None, clean[key], read[key]))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in FOUND.split(", ")])


def _tokens(suspects: set[str], wanted: frozenset[str] | None):
    """The words of recognised pages (of them only those `wanted`, where that
    set is small enough to have), and the suspect ideographs alone and with
    either neighbour."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for file_id, page_no, text in zip(f["file_id"], f["page_no"], f["text"]):
                found = {(text.count("\n", 0, m.start()) + 1, (m[1] + m[2]).lower(), len(m[1])) for m in CUT.finditer(text)}
                for i, x in enumerate(CUT.sub("  \n  ", text).lower().split("\n"), 1):
                    words = WORD.findall(x)
                    if wanted is None:
                        found.update((i, w, 0) for w in words if len(w) > 2 and not w.isdigit())
                    elif not wanted.isdisjoint(words):
                        found.update((i, w, 0) for w in wanted.intersection(words))
                if suspects and not suspects.isdisjoint(text):
                    kept = [(c, i) for i, x in enumerate(text.split("\n"), 1) for c in x]
                    for (a, i), (b, j) in pairwise(kept):
                        if a in suspects:
                            found.add((i, a + b, -1))
                        if b in suspects:
                            found.add((j, a + b, -2))
                    found.update((i, c, -3) for c, i in kept if c in suspects)
                out += [(file_id, page_no, *x) for x in found]
            yield pd.DataFrame(out, columns=["file_id", "page_no", "line_no", "word", "cut"])

    return run


def anagram_hash(word: Column) -> Column:
    """A sum over the characters, the same for every order of them."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda s, c: s + char_hash(c))


def char_hash(c: Column) -> Column:
    return F.when(c == "", F.lit(0).cast("long")).otherwise(F.shiftright(F.xxhash64(c), 8))


def known_confusions(spark: SparkSession) -> DataFrame:
    """right, wrong, shift: every known confusion and what it adds to the
    anagram hash of a word. A fixed table of some hundred rows."""
    pairs = spark.createDataFrame(sorted(set(KNOWN)), "right string, wrong string")
    return pairs.withColumn("shift", anagram_hash(F.col("right")) - anagram_hash(F.col("wrong")))


def replaced(word: str, place: str, wrong: str, right: str) -> Column:
    return F.concat(F.expr(f"left({word}, {place} - 1)"), F.col(right), F.expr(f"substring({word}, {place} + length({wrong}))"))


def known_corrections(rare: DataFrame, often: DataFrame) -> DataFrame:
    """word, fixed, place, f, right, wrong: rare words and the frequent words that one known
    confusion makes of them. The hash of a word, shifted by the difference
    that the confusion makes, is that of the right word."""
    size = F.explode(F.array(F.lit(1), F.lit(2))).alias("size")
    place = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("place")
    pieces = rare.select("word", "hw", "mw", place).select("*", size).withColumn("wrong", F.expr("substring(word, place, size)")).filter("length(wrong) = size")
    shifted = pieces.join(F.broadcast(known_confusions(rare.sparkSession)), "wrong").withColumn("hf", F.col("hw") + F.col("shift"))
    met = without_broadcast(shifted).join(often, "hf")
    return met.filter((F.col("fixed") == replaced("word", "place", "wrong", "right")) & F.expr("f >= 5 * mw")).select("word", "fixed", "place", "f", "right", "wrong")


def learnt_corrections(rare: DataFrame, often: DataFrame) -> DataFrame:
    """word, fixed, place, f: rare words and the frequent words they differ from
    in one character, by a pair of characters that explains many such words.
    The anagram hashes of both, less that character each, are equal."""

    def without_one(df: DataFrame, word: str, h: str) -> DataFrame:
        return df.select("*", F.length(word).alias("size"), F.explode(F.sequence(F.lit(1), F.length(word))).alias("place")).withColumn("key", F.col(h) - char_hash(F.substring(F.col(word), F.col("place"), F.lit(1))))

    met = without_broadcast(without_one(rare, "word", "hw")).join(without_one(often, "fixed", "hf"), ["size", "place", "key"])
    met = met.filter("f >= 5 * mw and word <> fixed and left(word, place - 1) = left(fixed, place - 1) and substring(word, place + 1) = substring(fixed, place + 1)")
    pair = F.concat(F.expr("substring(fixed, place, 1)"), F.expr("substring(word, place, 1)"))
    one = stage(met.select("word", "fixed", "place", "f", pair.alias("pair")), "candidates")
    explained = one.groupBy("pair").agg(F.count_distinct("word").alias("backing"))
    every = one.agg(F.count_distinct("word").alias("words"))
    backed = explained.crossJoin(F.broadcast(every)).filter((F.col("backing") >= 2) & (F.col("backing") >= BACKING * F.col("words"))).select("pair")
    return one.join(backed, "pair", "left_semi").select("word", "fixed", "place", "f")


def word_corrections(words: DataFrame, bigrams: DataFrame) -> DataFrame:
    """word, fixed, place: rare words of recognised pages, and rare pairs of
    neighbouring ideographs, with the frequent one each is a misreading of.
    Both frames: a, n (count on clean pages), m (on recognised ones). Ranked by
    known confusion first, then by the frequency of the right word. Of an
    ideograph that hardly stands on clean pages and has one known reading, the
    ideograph alone is a row as well (place 0)."""
    plain = words.filter("length(a) > 3 and not a like '%-%'").withColumn("latin", F.lit(True)).union(bigrams.withColumn("latin", F.lit(False))).withColumn("h", anagram_hash(F.col("a")))
    rare = plain.filter("m > 0 and n * 50 <= m and (not latin or a rlike '[^0-9].*[^0-9]')").select(F.col("a").alias("word"), F.col("h").alias("hw"), F.col("m").alias("mw"), "latin")
    often = plain.filter("n + m >= 3 and not a rlike '[0-9]' and (n > 0 or n + m >= 20)").select(F.col("a").alias("fixed"), F.col("h").alias("hf"), (F.col("n") + F.col("m")).alias("f"), "latin")
    known = known_corrections(rare.drop("latin"), often.drop("latin"))
    learnt = learnt_corrections(rare.filter("latin").drop("latin"), often.filter("latin").drop("latin"))
    both = known.select("word", "fixed", "place", "f", F.lit(True).alias("known")).union(learnt.select("*", F.lit(False)))
    return both.groupBy("word").agg(F.max_by(F.struct("fixed", "place"), F.struct("known", "f", "fixed")).alias("best")).select("word", "best.fixed", F.when(F.col("word").rlike(HAN.pattern), 0).otherwise(F.col("best.place")).alias("place"))


def rare_ideographs(chars: DataFrame) -> DataFrame:
    """x: the ideographs whose rate on clean pages is under a tenth of that on recognised ones."""
    totals = chars.agg(F.sum("n").alias("tn"), F.sum("m").alias("tm"))
    return chars.crossJoin(F.broadcast(totals)).filter("m > 0 and tn > 0 and n * tm * 10 < m * tn").select(F.col("a").alias("x"))


def ideograph_corrections(chars: DataFrame, bigrams: DataFrame, known: DataFrame) -> DataFrame:
    """word, fixed: single ideographs and pairs that are misread, beyond those
    of `known` (word, fixed: pairs by known confusions).

    An ideograph that hardly stands on clean pages is misread. If known
    confusions explain half of where it stands, and nine tenths of that by one
    reading, that is its reading wherever it stands. Otherwise it is read as
    the ideograph that makes frequent pairs of most of its pairs, if that
    explains MARGIN times as much as the next; if not, fixed is null."""
    x = stage(rare_ideographs(chars), "rare")
    pieces = bigrams.select(F.col("a").alias("word"), "n", "m", F.explode(F.array(F.lit(1), F.lit(2))).alias("place")).withColumn("c", F.expr("substring(word, place, 1)")).withColumn("other", F.expr("substring(word, 3 - place, 1)"))
    wrong = stage(pieces.join(x, F.col("c") == F.col("x"), "left_semi").select("word", F.col("m").alias("mw"), "place", "other", F.col("c").alias("x")), "suspects")
    of_x = wrong.groupBy("x").agg(F.sum("mw").alias("all"))
    by_shape = wrong.join(known.select("word", "fixed"), "word").withColumn("y", F.expr("substring(fixed, place, 1)")).filter("x <> y")
    shapes = by_shape.groupBy("x", "y").agg(F.sum("mw").alias("mass"))
    settled = shapes.groupBy("x").agg(F.max_by("y", F.struct("mass", "y")).alias("y"), F.max("mass").alias("most"), F.sum("mass").alias("mass")).join(of_x, "x").filter("2 * mass >= all")
    alone = settled.filter("most >= 0.9 * mass").select(F.col("x").alias("word"), F.col("y").alias("fixed"))
    # by neighbours: of a pair less one character, hash and place are left: the other one
    open_ = wrong.join(settled.select("x"), "x", "left_anti")
    right = pieces.filter("n >= 2").select(F.col("word").alias("fixed"), F.col("n").alias("nf"), "place", "other", F.col("c").alias("y"))
    met = open_.join(right, ["place", "other"]).filter("x <> y and nf >= 2 * mw")
    pair = met.groupBy("x", "y").agg(F.sum("mw").alias("explained"), F.count_distinct("place").alias("sides")).join(of_x, "x").filter("explained * 2 >= all and sides = 2")
    ranked = pair.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("explained", "y")), False).alias("r"))
    second = F.coalesce(F.try_element_at("r", F.lit(2))["explained"], F.lit(0))
    by_side = ranked.select(F.col("x").alias("word"), F.when(F.col("r")[0]["explained"] >= MARGIN * second, F.col("r")[0]["y"]).alias("fixed"))
    return alone.union(by_side)


def running_titles(edge: DataFrame, skeleton: DataFrame) -> DataFrame:
    """file_id, page_no, line_no of the edge lines that are running titles.
    `edge`: file_id, source_file, page_no, line_no, a; `skeleton`: source_file, num, title."""
    often = edge.groupBy("file_id", "a").agg(F.count_distinct("page_no").alias("pages")).filter("pages > 1").select("file_id", "a")
    bare = F.regexp_replace(F.lower("title"), r"\s+", "")
    named = F.explode(F.array(F.concat(F.lit("chapter"), F.col("num").cast("string"), bare), F.concat(F.lit("第"), F.col("num").cast("string"), F.lit("章"), bare), bare))
    files = edge.select("file_id", "source_file").distinct()
    of_chapters = skeleton.select("source_file", named.alias("a")).filter("length(a) > 2").join(files, "source_file").select("file_id", "a")
    titles = often.union(of_chapters).distinct()
    edge = without_broadcast(edge)
    exact = edge.join(titles, ["file_id", "a"], "left_semi").select("file_id", "page_no", "line_no")
    left = edge.join(titles, ["file_id", "a"], "left_anti").filter(f"length(a) >= 4 and not a like '{HASHED}%'")

    def thirds(df: DataFrame, name: str) -> DataFrame:
        n = F.length("a")
        cut = F.floor(n / 3).cast("int")
        parts = F.array(F.struct(F.lit(0).alias("p"), F.expr("left(a, int(length(a) / 3))").alias("t")), F.struct(F.lit(1).alias("p"), F.substring(F.col("a"), cut + 1, cut).alias("t")), F.struct(F.lit(2).alias("p"), F.substring(F.col("a"), 2 * cut + 1, n).alias("t")))
        return df.withColumn("size", n).withColumn("_p", F.explode(parts)).select("*", "_p.p", "_p.t").drop("_p").withColumnRenamed("a", name)

    near = without_broadcast(thirds(left, "a1")).join(thirds(titles, "a2"), ["file_id", "size", "p", "t"]).filter(F.levenshtein("a1", "a2") <= F.when(F.col("size") < 8, 1).otherwise(2))
    return exact.union(near.select("file_id", "page_no", "line_no")).distinct()


def page_numbers(num: DataFrame, labels: DataFrame) -> DataFrame:
    """file_id, page_no, line_no of the edge lines that are the printed page
    number: the label's, or without a label the one that the file's other
    labels make likely; a dressed number without any label counts as well.
    `labels`: file_id, page_no, number."""
    offset = labels.filter("number rlike '^[0-9]{1,6}$'").select("file_id", (F.col("number").cast("int") - F.col("page_no")).alias("off")).groupBy("file_id", "off").count()
    offset = offset.groupBy("file_id").agg(F.max_by("off", F.struct("count", "off")).alias("off"))
    known = without_broadcast(without_broadcast(num).join(labels, ["file_id", "page_no"], "left")).join(offset, "file_id", "left")
    likely = F.coalesce("number", (F.col("page_no") + F.coalesce("off", F.lit(0))).cast("string"))
    return known.filter((F.col("a") == likely) | (F.col("number").isNull() & (F.col("b") == "dressed"))).select("file_id", "page_no", "line_no").distinct()


@F.pandas_udf(StringType())
def printed_number(label: pd.Series) -> pd.Series:
    return pd.Series([label_number(x)[0] for x in label], dtype=object)


@F.pandas_udf(StringType())
def label_misread(label: pd.Series) -> pd.Series:
    return pd.Series(["y" if label_number(x)[1] else "n" for x in label], dtype=object)


#: Corrections up to this number go to the workers, which then send on only what is misread.
FEW = 200_000


def page_faults(pages: DataFrame, skeleton: DataFrame) -> DataFrame:
    """file_id, page_no, line_no, issue, wrong, fixed: one row per fault.

    pages: file_id, source_file, page_no, page_label, text, text_source (`ocr`
    for recognised pages; only these have misread characters). Lines are split
    at LF and counted from 1. issue: header, page_number, hyphen, misread, or,
    at line 0, label. A line is a header or page number rather than misread or
    hyphenated. Null or empty texts have no lines, a null label no fault, rows
    with a null key are left out, rows repeated in full count once. wrong and
    fixed are words for hyphen and misread, labels for label, else null; fixed
    is null as well where a misread ideograph has no reading likely enough.
    """
    rows = pages.filter("file_id is not null and page_no is not null")
    texts = rows.filter("length(text) > 0").select("file_id", "page_no", "text", F.coalesce(F.col("text_source") == "ocr", F.lit(False)).alias("ocr"))
    found = stage(texts.mapInPandas(_survey, FOUND), "survey", by="kind")
    counts = {k: stage(found.filter(F.col("kind") == k).groupBy("a").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), f"count-{k}") for k in ("word", "han", "char")}

    files = rows.select("file_id", "source_file").distinct()
    edge = found.filter("kind = 'edge'").select("file_id", "page_no", "line_no", "a").distinct()
    edge = without_broadcast(edge).join(files, "file_id")
    titles = running_titles(edge, skeleton)
    labels = rows.select("file_id", "page_no", "page_label").filter("page_label is not null").distinct()
    numbers = page_numbers(found.filter("kind = 'num'").select("file_id", "page_no", "line_no", "a", "b").distinct(), labels.select("file_id", "page_no", printed_number("page_label").alias("number")).groupBy("file_id", "page_no").agg(F.min("number").alias("number")))
    none = [F.lit(None).cast("string").alias(c) for c in ("wrong", "fixed")]
    at_edge = numbers.select("*", F.lit("page_number").alias("issue")).union(titles.select("*", F.lit("header").alias("issue")))
    edge_lines = stage(at_edge.groupBy("file_id", "page_no", "line_no").agg(F.max("issue").alias("issue")).select("*", *none), "edges")

    words = stage(word_corrections(counts["word"], counts["han"]), "words")
    han = stage(ideograph_corrections(counts["char"], counts["han"], words.filter("place = 0")), "han")
    # single ideographs, so at most as many as there are
    wrong_of = F.when(F.length("word") == 1, F.col("word")).when(F.left("word", F.lit(1)) != F.left("fixed", F.lit(1)), F.left("word", F.lit(1))).otherwise(F.right("word", F.lit(1)))
    fixes = words.union(han.select("word", "fixed", F.lit(0).alias("place")))
    suspects = {r["x"] for r in fixes.filter("place = 0").select(wrong_of.alias("x")).distinct().collect()}
    few = fixes.select("word").limit(FEW + 1).collect()
    wanted = frozenset(r["word"] for r in few) if len(few) <= FEW else None
    tokens = texts.filter("ocr").mapInPandas(_tokens(suspects, wanted), "file_id string, page_no int, line_no int, word string, cut int")
    misread = without_broadcast(tokens).join(fixes, "word").withColumn("line_no", F.when((F.col("cut") > 0) & (F.col("place") > F.col("cut")), F.col("line_no") + 1).otherwise(F.col("line_no")))
    misread = misread.select("file_id", "page_no", "line_no", F.lit("misread").alias("issue"), F.col("word").alias("wrong"), "fixed")

    cut = found.filter("kind = 'cut'").select("file_id", "page_no", "line_no", F.col("a").alias("joined"), F.col("b").alias("cut"), F.col("n").alias("at"))
    known = counts["word"].select(F.col("a").alias("w"), (F.col("n") + F.col("m")).alias("f"))
    pieces = {"cut": F.col("cut"), "joined": F.col("joined"), "left": F.expr("left(cut, int(at))"), "right": F.expr("substring(cut, int(at) + 2)")}
    each = cut.select("joined", "cut", "at").distinct().select("joined", "cut", F.explode(F.array(*(F.struct(F.lit(k).alias("of"), c.alias("w")) for k, c in pieces.items()))).alias("p")).select("joined", "cut", "p.*")
    forms = without_broadcast(each).join(known, "w", "left").groupBy("joined", "cut").agg(*(F.coalesce(F.max(F.when(F.col("of") == k, F.col("f"))), F.lit(0)).alias(f"f_{k}") for k in pieces))
    read = forms.join(words.select(F.col("word").alias("joined"), F.col("fixed").alias("_fixed")), "joined", "left")
    whole = F.when(F.col("f_cut") > F.col("f_joined"), False).when((F.col("f_joined") > 0) | F.col("_fixed").isNotNull(), True).otherwise(~((F.col("f_left") > 2) & (F.col("f_right") > 2)))
    hyphen = without_broadcast(cut).join(read.filter(whole).select("joined", "cut"), ["joined", "cut"], "left_semi").select("file_id", "page_no", "line_no", F.lit("hyphen").alias("issue"), F.col("cut").alias("wrong"), F.col("joined").alias("fixed"))

    body = without_broadcast(misread.union(hyphen)).join(edge_lines.select("file_id", "page_no", "line_no"), ["file_id", "page_no", "line_no"], "left_anti")
    wrong_labels = labels.filter(label_misread("page_label") == "y").select("file_id", "page_no", F.lit(0).alias("line_no"), F.lit("label").alias("issue"), F.col("page_label").alias("wrong"), printed_number("page_label").alias("fixed"))
    return edge_lines.unionByName(body).unionByName(wrong_labels).distinct()
