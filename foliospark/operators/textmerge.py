"""Merging of recognised texts of one region, in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Numbers of characters of a word by which texts meet.
STEMS = (1, 2, 4, 8, 16, 32)


def _words(text: str) -> str:
    return f"filter(split({text}, '(?U)\\\\s+'), w -> w <> '')"


def _last(words: str, n: int) -> str:
    return f"array_join(slice({words}, -{n}, {n}), ' ')"


def _first(words: str, n: int) -> str:
    return f"array_join(slice({words}, 1, {n}), ' ')"


def continues(a: str, b: str, wa: str, wb: str) -> str:
    """Whether text b begins with the last one to three words of a, or a ends with the first of b."""
    heads = [f"(size({wa}) >= {n} and startswith({b}, {_last(wa, n)}))" for n in (1, 2, 3)]
    tails = [f"(size({wb}) >= {n} and endswith({a}, {_first(wb, n)}))" for n in (1, 2, 3)]
    return "(" + " or ".join(heads + tails) + ")"


def spliced(a: str, b: str, wa: str) -> str:
    """a continued by b where they overlap, by the fewest words; a alone if b begins with all of it or nothing overlaps."""
    cases = " ".join(f"when size({wa}) >= {n} and startswith({b}, {_last(wa, n)}) then concat({a}, substring({b}, length({_last(wa, n)}) + 1))" for n in (1, 2, 3))
    return f"(case when startswith({b}, {a}) then {a} {cases} else {a} end)"


def continuation_pairs(elements: DataFrame) -> DataFrame:
    """image_id, a_id, b_id of texts of a page, in both orders, of which the second continues the first.

    What begins with n words begins with n - 1 whole words and with the last one as a part of its own n-th word, so texts meet by keys: 96 bits of hashes of
    the whole words and of the first characters of the other one, as many of STEMS as it has; the rest of that word is compared. The same holds for ends. Texts
    without words meet nothing.
    """
    texts = elements.where("type = 'text' and text is not null").select("image_id", "element_id", "text", F.expr(_words("text")).alias("words"))
    spread = texts.withColumn("n", F.explode(F.expr("filter(array(1, 2, 3), n -> n <= size(words))")))
    first, last = "array_join(slice(words, 1, n), ' ')", "array_join(slice(words, -n, n), ' ')"
    # The word that is met in part, the whole words beside it, and which end of the word counts.
    ends = ("try_element_at(words, -1)", "slice(words, -n, n - 1)"), ("get(words, 0)", "slice(words, 2, n - 1)")
    askers = (f"startswith(text, {first})", "get(words, n - 1)", "slice(words, 1, n - 1)"), (f"endswith(text, {last})", "try_element_at(words, -n)", "slice(words, least(1 - n, -1), n - 1)")
    found = []
    for (word, beside), (whole, own, own_beside), side, test, a, b in zip(ends, askers, ("left", "right"), ("startswith", "endswith"), ("k", "q"), ("q", "k")):
        met = lambda beside, stem: (f"xxhash64(image_id, {beside}, {stem}) as h", f"hash({stem}, n, {beside}, image_id) as g")
        longest = f"array_max(filter(array{STEMS}, m -> m <= length(word)))"
        keys = spread.selectExpr("image_id", "element_id", "n", f"{beside} as beside", f"{word} as word")
        keys = keys.selectExpr("image_id", "element_id", "word", *met("beside", f"{side}(word, {longest})"))
        asked = spread.where(whole).selectExpr("image_id", "element_id", "n", f"{own_beside} as beside", f"{own} as word")
        asked = asked.selectExpr("*", f"explode(filter(array{STEMS}, m -> m <= length(word))) as m").selectExpr("image_id", "element_id", "word", *met("beside", f"{side}(word, m)"))
        on = F.expr(f"k.image_id = q.image_id and k.h = q.h and k.g = q.g and k.element_id <> q.element_id and {test}(q.word, k.word)")
        found.append(keys.alias("k").join(asked.alias("q"), on).selectExpr("k.image_id as image_id", f"{a}.element_id as a_id", f"{b}.element_id as b_id"))
    return found[0].union(found[1]).distinct()


def merged_texts(elements: DataFrame, keys: list[str], position: int = 5, near: int = 50) -> DataFrame:
    """keys, item_no, text, confidence, box: text elements of each group after merging from the top.

    By (top, left, id), an element joins the current one if it is at nearly the same position (the longer text stays, the
    later of equally long ones), if its text continues the current one, or if the boxes are within ``near`` on both axes.
    """
    item = f"struct(top_y, left_x, element_id, right_x, bottom_y, text, coalesce(confidence, 1.0D) as confidence, {_words('text')} as words)"
    kind = "struct<left_x:bigint,top_y:bigint,right_x:bigint,bottom_y:bigint,text:string,confidence:double>"
    fields = ("left_x", "top_y", "right_x", "bottom_y", "text", "confidence")
    plain = "named_struct(" + ", ".join(f"'{f}', x.{f}" for f in fields) + ")"
    c, wc = "acc.cur", _words("acc.cur.text")
    same = f"(abs({c}.left_x - x.left_x) <= {position} and abs({c}.top_y - x.top_y) <= {position})"
    goes_on = continues(f"{c}.text", "x.text", wc, "x.words")
    beside = f"({c}.right_x >= x.left_x - {near} and {c}.left_x <= x.right_x + {near} and {c}.bottom_y >= x.top_y - {near} and {c}.top_y <= x.bottom_y + {near})"
    text = f"(case when {same} then if(length({c}.text) > length(x.text), {c}.text, x.text) when {goes_on} then {spliced(f'{c}.text', 'x.text', wc)} else concat({c}.text, ' ', x.text) end)"
    joined = (
        f"named_struct('left_x', least({c}.left_x, x.left_x), 'top_y', least({c}.top_y, x.top_y), 'right_x', greatest({c}.right_x, x.right_x), "
        f"'bottom_y', greatest({c}.bottom_y, x.bottom_y), 'text', {text}, 'confidence', greatest({c}.confidence, x.confidence))"
    )
    step = (
        f"case when {c} is null then named_struct('cur', {plain}, 'out', acc.out) "
        f"when {same} or {goes_on} or {beside} then named_struct('cur', {joined}, 'out', acc.out) "
        f"else named_struct('cur', {plain}, 'out', array_append(acc.out, {c})) end"
    )
    start = f"named_struct('cur', cast(null as {kind}), 'out', cast(array() as array<{kind}>))"
    fold = f"aggregate(array_sort(collect_list({item})), {start}, (acc, x) -> {step}, acc -> array_append(acc.out, acc.cur))"
    found = elements.where("type = 'text' and text is not null").groupBy(*keys).agg(F.expr(fold).alias("found"))
    out = found.select(*keys, F.posexplode("found").alias("pos", "t"))
    return out.select(*keys, (F.col("pos") + 1).cast("long").alias("item_no"), *(F.col(f"t.{f}").alias(f) for f in ("text", "confidence", "left_x", "top_y", "right_x", "bottom_y")))
