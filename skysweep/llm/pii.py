"""Surrogates for personal data and secrets, by DataFrame operations only.

Detected: e-mail addresses, phone numbers, US social security numbers, card numbers (with a right check digit), IPv4 addresses, IBANs, access keys,
secrets after a word such as "password=" or "token =", and names after a form of address.

An entity is a kind and a normal form (digits without marks, lower-case addresses, single name words), so that its mentions share one surrogate in all documents, whatever
their format: coreference is kept. A name once found is replaced in its bare mentions in the same document too, and a given name has one gender: that of its mentions with a form of address
that tells it, the more frequent one if they differ. A surrogate is drawn from a keyed hash of the entity, and has the entity's kind: cards keep
issuer and check rule, addresses the country of IBANs, names gender (of the form of address) and script. Each mention keeps its own format. Collision check:
surrogates that two entities share, or that are themselves entities of the corpus, are drawn anew until there is none, so distinct entities stay distinct. A later draw has
more room: names grow by a syllable a draw, and kinds of a fixed format use all of it from draw WIDER on, and from draw CROWDED on also surrogates that are entities, so that the room is
never less than the entities need. A mention's surrogate is worked out in its own row; only entities drawn anew, and given names whose
mentions differ in gender, are looked up. The key comes to the rows as a value, not as a part of any plan, so that no log shows it.

Null and empty texts are unchanged, as is all text outside the entities. Rows that repeat are treated alike. Other columns are kept as they are, whatever their names; one with
the name of the count of mentions gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysweep.llm.common import aside, dropped, written

# Forms of address by gender.
MALE = "Mr Herr Señor Sr Monsieur Господин Mister Don"
FEMALE = "Mrs Ms Miss Frau Señora Señorita Sra Madame Mme Mademoiselle Mlle Госпожа Doña"
EITHER = "Dr Prof Professor Mx"
_TITLES = "|".join(f"[{x[0]}{x[0].lower()}]{x[1:]}" for x in f"{MALE} {FEMALE} {EITHER}".split())
_WORD = r"\p{Lu}(?:\p{Ll}++|\p{Lu}++(?!\p{Ll}))(?:-\p{Lu}(?:\p{Ll}++|\p{Lu}++))?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_SECRET = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}"

#: The kinds' patterns, tried in this order. Every repetition is bounded, or possessive as in secrets, which are as long as their run of signs.
#: The look-ahead for a secret's digit goes to the first digit of the run, or to its end.
PATTERNS = {
    "secret": _SECRET + r'"?(?=[^\s"\d]*+\d)[^\s"]{6,}+"?|(?i:password|passwd|pwd)[ \t]{0,3}=[ \t]{0,3}"?[^\s"]{8,}+"?',
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "key": r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "card": r"(?<![\d.-])(?:(?:\d{4}[ -]?){3}\d{4}|\d{4}[ -]?\d{6}[ -]?\d{5})(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}([.-])\d{3}\1\d{4}(?![\d-])",
    "name": rf"(?<!\p{{L}})(?:{_TITLES})\.? {_WORD}(?: {_WORD}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values()).replace(r"([.-])\d{3}\1", r"[.-]\d{3}[.-]")
#: What a text with an entity has at least; quick to look for.
HINT = rf"[0-9@]|[Pp]assw|PASSW|[Pp]wd|PWD|(?:{_TITLES})\.? \p{{Lu}}"
#: Draws from which kinds of a fixed format use all of it, and may use other entities.
WIDER, CROWDED = 3, 30


def _sql(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def mentions(text: str = "text") -> Column:
    """All mentions in a text, in order; null where there is no hint of one."""
    return F.expr(f"case when {text} rlike {_sql(HINT)} then regexp_extract_all({text}, {_sql(ANY)}, 0) end")


_LUHN = (
    "(aggregate(transform(reverse(split(regexp_replace(m, '[^0-9]', ''), '')), (c, i) -> cast(c as int) * (1 + i % 2)), 0L, (a, x) -> a + x div 10 + x % 10) % 10 = 0)"
)


def _kind() -> Column:
    tests = [(k, f"m rlike {_sql(f'^(?:{p})$')}") for k, p in PATTERNS.items()]
    whole = " ".join(f"when {t} then " + (f"if({_LUHN}, 'card', null)" if k == "card" else f"'{k}'") for k, t in tests)
    return F.expr(f"case {whole} end")


_DIGITS = "regexp_replace(token, '[^0-9]', '')"


def entities(hits: DataFrame) -> DataFrame:
    """From (row, hits): one row per word of a name, or mention of another kind: row, pos, w, token, kind, norm (null: no entity), gender (m, f or n, of the form of address)."""
    rows = hits.select("row", F.posexplode("hits").alias("pos", "m")).withColumn("type", _kind())
    rows = rows.select("row", "pos", "type", "m", F.posexplode(F.expr("if(type = 'name', split(m, ' '), array(m))")).alias("w", "token"))
    titles = [f"when initcap(regexp_replace(element_at(split(m, ' '), 1), '[.]', '')) in ({', '.join(_sql(x) for x in names.split())}) then '{g}'" for g, names in (("m", MALE), ("f", FEMALE))]
    gender = f"case {' '.join(titles)} else 'n' end"
    script = "case when token rlike '\\\\p{IsCyrillic}' then 'cyrillic' when token rlike '\\\\p{IsGreek}' then 'greek' else 'latin' end"
    kind = f"""case when type = 'name' then if(w = 0, null, concat(if(w = 1 and size(split(m, ' ')) > 2, 'given', 'family'), '_', {script}))
        when type = 'phone' then 'phone' when type = 'secret' then 'secret' else type end"""
    norm = f"""case when type = 'name' then lower(token) when type = 'email' then lower(token)
        when type = 'phone' then if(length({_DIGITS}) = 11 and {_DIGITS} like '1%', substr({_DIGITS}, 2), {_DIGITS})
        when type in ('card', 'ssn') then {_DIGITS} when type = 'iban' then regexp_replace(token, ' ', '')
        when type = 'secret' then regexp_replace(regexp_replace(token, {_sql('^' + _SECRET)}, ''), '"', '') else token end"""
    rows = rows.withColumn("kind", F.expr(kind)).withColumn("gender", F.expr(f"if(kind like 'given%', {gender}, 'n')"))
    return rows.withColumn("norm", F.expr(f"case when kind is not null then {norm} end")).drop("m", "type")


def _spelled(syllables: str, length: str) -> str:
    """A name word from the first signs of the hash h, a syllable each."""
    table = "array({})".format(", ".join(_sql(x) for x in syllables.split()))
    return f"initcap(array_join(transform(sequence(1, {length}), i -> element_at({table}, cast(conv(substr(h, i, 1), 16, 10) as int) + 1)), ''))"


_LATIN = "ba be bo da de do ka ke la lo ma mi na ro sa ti"
_CYRILLIC = "ба бе бо да де до ка ке ла ло ма ми на ро са ти"
_GREEK = "βα βε βο δα δε δο κα κε λα λο μα μι να ρο σα τι"


def secret(spark: SparkSession, key: str) -> Column:
    """The key as a value that the plan only refers to."""
    values = spark._jvm.java.util.ArrayList()
    values.add(key)
    one = DataFrame(spark._jsparkSession.createDataset(values, spark._jvm.org.apache.spark.sql.Encoders.STRING()), spark)
    return one.agg(F.max("value")).scalar()


def _drawn(rows: DataFrame, key: Column) -> DataFrame:
    """rows (kind, norm, gender, draw) with surrogate, in normal form; null without a kind."""
    h = "sha2(concat(key_, '|', kind, '|', norm, '|', cast(draw as string)), 256)"
    digits = "translate(h, 'abcdef', '012345')"
    stream = "translate(h, '0123456789', 'ghijklmnop')"
    body = f"concat(substr(norm, 1, 1), substr({digits}, 1, length(norm) - 2))"
    card = f"concat({body}, cast((10 - aggregate(transform(reverse(split({body}, '')), (x, i) -> cast(x as int) * (2 - i % 2)), 0L, (a, x) -> a + x div 10 + x % 10) % 10) % 10 as string))"
    room = "5 + least(draw, 50)"
    octet = "cast(cast(conv(substr(h, {}, 4), 16, 10) as int) % 256 as string)"
    local = f"concat(substr({stream}, 1, least(24, greatest(8, length(regexp_replace(substring_index(norm, '@', 1), '[^a-z]', ''))))), if(substring_index(norm, '@', 1) rlike '[0-9]$', concat('.', substr({digits}, 30, 2)), ''))"
    tld = "if(substring_index(norm, '.', -1) in ('com', 'org', 'net'), substring_index(norm, '.', -1), 'org')"
    signs = f"array_join(transform(split(substr(norm, 5), ''), (x, i) -> case when x rlike '[0-9]' then substr({digits}, i % 60 + 3, 1) when x rlike '[A-Z]' then upper(substr({stream}, i % 60 + 3, 1)) else x end), '')"
    ending = "case gender when 'f' then '{}' when 'm' then '{}' else '{}' end"
    value = f"""case
        when kind = 'email' then concat({local}, '@mail.example.', {tld})
        when kind = 'phone' then substr(concat(if(draw < {WIDER}, cast(cast(substr({digits}, 1, 1) as int) % 8 + 2 as string), substr({digits}, 1, 1)), substr({digits}, 2)), 1, length(norm))
        when kind = 'ssn' then concat(if(draw < {WIDER}, '9', substr({digits}, 9, 1)), substr({digits}, 1, 8))
        when kind = 'card' then {card}
        when kind = 'ip' then concat_ws('.', if(draw < {WIDER}, cast(240 + cast(conv(substr(h, 1, 4), 16, 10) as int) % 15 as string), {octet.format(1)}), {octet.format(5)}, {octet.format(9)}, {octet.format(13)})
        when kind = 'key' then concat(substr(norm, 1, 4), upper(substr(h, 1, 16)))
        when kind = 'iban' then concat(substr(norm, 1, 2), substr({digits}, 1, 2), {signs})
        when kind = 'secret' then substr(repeat(if(draw < {WIDER}, h, lower(translate(base64(unhex(h)), '+/=', 'xyz'))), cast(length(norm) div 40 + 1 as int)), 1, length(norm))
        when kind like '%cyrillic' then lower(concat({_spelled(_CYRILLIC, room)}, {ending.format('на', 'н', 'ский')}))
        when kind like '%greek' then lower(concat({_spelled(_GREEK, room)}, {ending.format('να', 'νος', 'ρης')}))
        else lower(concat({_spelled(_LATIN, room)}, {ending.format('na', 'n', 'rd')})) end"""
    return rows.withColumn("key_", key).withColumn("surrogate", F.expr(f"case when kind is not null then element_at(transform(array({h}), h -> {value}), 1) end")).drop("key_")


def drawn_anew(found: DataFrame, key: Column) -> DataFrame:
    """(kind, norm, gender, draw) of the entities of found (kind, norm, gender) whose first surrogate is another's too, or an entity, with the draw that is free of collisions; and of the given names
    that have mentions of more than one gender."""
    counts = found.where("kind is not null").groupBy("kind", "norm").agg(F.count_if(F.col("gender") == "f").alias("f"), F.count_if(F.col("gender") == "m").alias("m"), F.count("*").alias("n"))
    every = counts.selectExpr("kind", "norm", "case when f > 0 and f >= m then 'f' when m > 0 then 'm' else 'n' end as gender", "greatest(f, m, n - f - m) < n as differs", "0 as draw")
    drawn = written(_drawn(every, key))
    while True:
        shared = drawn.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("norm").alias("keeper")).where("n > 1").select("kind", "surrogate", "keeper")
        real = drawn.where(f"draw < {CROWDED}").join(drawn.selectExpr("kind", "norm as surrogate"), ["kind", "surrogate"], "left_semi").select("kind", "norm")
        again = drawn.join(shared, ["kind", "surrogate"]).where("norm <> keeper").select("kind", "norm").unionByName(real).distinct()
        again = written(again.withColumn("again", F.lit(1)))
        if again.isEmpty():
            return drawn.where("draw > 0 or differs").select("kind", "norm", "gender", "draw")
        before, drawn = drawn, written(_drawn(drawn.join(again, ["kind", "norm"], "left").withColumn("draw", F.expr("draw + coalesce(again, 0)")).drop("again", "surrogate"), key))
        dropped(before, again)


def _formatted() -> Column:
    """The surrogate in the format of the mention: its digits or signs take the places of the mention's own, from the end."""
    # i counts up to the place in the surrogate; signs before it (a country code) stay
    fill = """aggregate(split(token, ''), struct('' as out, length(surrogate) - length(regexp_replace(token, '{other}', '')) as i),
        (a, c) -> if(c rlike '{sign}', struct(concat(a.out, if(a.i < 0, c, substr(surrogate, a.i + 1, 1))) as out, a.i + 1 as i), struct(concat(a.out, c) as out, a.i as i)), a -> a.out)"""
    return F.expr(f"""case when surrogate is null then token
        when kind in ('phone', 'card', 'ssn') then {fill.format(other='[^0-9]', sign='[0-9]')}
        when kind = 'iban' then {fill.format(other='[^A-Z0-9]', sign='[A-Z0-9]')}
        when kind = 'secret' then concat(regexp_extract(token, {_sql('^' + _SECRET + '"?')}, 0), if(norm = upper(norm), upper(surrogate), surrogate), if(token like '%"', '"', ''))
        when kind like 'given%' or kind like 'family%' then initcap(surrogate)
        else surrogate end""")


def replace_entities(docs: DataFrame, key: str, count: str | None = "n_entities") -> DataFrame:
    """docs with text changed, and one more column unless count is None: mentions replaced. key: the secret that the surrogates depend on."""
    docs = docs.drop(count) if count in docs.columns else docs
    own, names, back = aside(docs, "text")
    # looking for mentions is the costly part: it is done once, and its result kept with the rows
    marked = written(own.withColumn("hits", mentions()).withColumn("row", F.monotonically_increasing_id()))
    none = marked.where("coalesce(size(hits), 0) <= 0").select(*names, F.lit(0).cast("bigint").alias("n"))
    some = marked.where("size(hits) > 0")
    found = written(entities(some.select("row", "hits")))
    hidden = secret(docs.sparkSession, key)
    looked = drawn_anew(found, hidden).withColumnsRenamed({"gender": "gender_", "draw": "draw_"})
    fixed = found.join(looked, ["kind", "norm"], "left").withColumns({"draw": F.expr("coalesce(draw_, 0)"), "gender": F.expr("coalesce(gender_, gender)")})
    fixed = _drawn(fixed, hidden).withColumn("new", _formatted())
    name = "case when kind like 'given%' or kind like 'family%' then struct(token, new) end"
    by_mention = fixed.groupBy("row", "pos").agg(F.expr("array_join(transform(array_sort(collect_list(struct(w, new))), x -> x.new), ' ')").alias("new"), F.max(F.expr("int(surrogate is not null)")).alias("n"), F.expr(f"collect_set({name})").alias("bare"))
    by_row = by_mention.groupBy("row").agg(F.expr("transform(array_sort(collect_list(struct(pos, new))), x -> x.new)").alias("new"), F.sum("n").alias("n"), F.expr("array_distinct(flatten(collect_list(bare)))").alias("bare"))
    # between the mentions, bare words of the document's names are replaced as well; one pass a name over what is not a mention
    parts = f"split(text, {_sql(ANY)}, -1)"
    alone = f"aggregate(filter(bare, x -> contains(a, x.token)), a, (t, x) -> regexp_replace(t, concat({_sql('(?<![' + chr(92) + 'p{L}' + chr(92) + 'p{N}_-])')}, x.token, {_sql('(?![' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])')}), x.new))"
    text = f"array_join(zip_with(transform({parts}, a -> {alone}), new, (a, b) -> concat(a, coalesce(b, ''))), '')"
    done = some.join(by_row, "row").withColumn("text", F.expr(text)).select(*names, "n")
    return back(none.unionByName(done), *([F.col("n").alias(count)] if count else []))
