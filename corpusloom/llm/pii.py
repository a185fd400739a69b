"""Surrogates for personal data: keyed, of the same type and format, distinct and coreferent.

Detected entities are brought to a canonical form, so that two spellings of one number are
one entity. A keyed Feistel network turns the canonical symbols into others of the same
class (digit, vowel, consonant, script), which is one-to-one for entities of one shape;
check digits of cards and account numbers are worked out anew. Names are drawn entity by
entity from lists of their gender and script. Surrogates that meet a real entity of the
corpus or each other are drawn again under another tweak and checked against all that are
in use. What comes out is written in the format of each mention, and single words of a
detected name that stand elsewhere in its document are replaced alike. Everything is
DataFrame functions.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, bare, forget, packed, staged, unpacked

#: Titles by gender, first names by gender and script, and the beginnings and ends that make up surnames.
TITLES = {
    "male": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"),
    "female": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señora", "Sra", "Госпожа"),
    "": ("Dr", "Prof"),
}
FIRST_NAMES = {
    ("female", "latin"): ("Alice", "Amelia", "Anna", "Beatrice", "Camille", "Carmen", "Caroline", "Charlotte", "Clara", "Claire", "Diana", "Elena", "Eleanor", "Emily", "Emma", "Eva", "Florence", "Frida", "Gabriela", "Greta", "Hannah", "Helena", "Ines", "Ingrid", "Isabel", "Jane", "Johanna", "Julia", "Karin", "Laura", "Lucia", "Margaret", "Maria", "Marta", "Nora", "Olivia", "Paula", "Rosa", "Sarah", "Sofia", "Teresa", "Victoria"),
    ("male", "latin"): ("Adam", "Albert", "Alexander", "Andrew", "Anton", "Arthur", "Benjamin", "Carlos", "Charles", "Daniel", "David", "Diego", "Edward", "Erik", "Felix", "Francis", "Frank", "George", "Hans", "Henry", "Hugo", "Jacob", "James", "John", "Joseph", "Leon", "Louis", "Luis", "Martin", "Michael", "Miguel", "Oliver", "Oscar", "Paul", "Peter", "Philip", "Pierre", "Robert", "Samuel", "Simon", "Thomas", "Victor"),
    ("female", "cyrillic"): ("Александра", "Анастасия", "Анна", "Вера", "Галина", "Дарья", "Екатерина", "Елена", "Ирина", "Ксения", "Людмила", "Мария", "Надежда", "Наталья", "Ольга", "Полина", "Светлана", "Софья", "Татьяна", "Юлия"),
    ("male", "cyrillic"): ("Александр", "Алексей", "Андрей", "Борис", "Виктор", "Владимир", "Григорий", "Дмитрий", "Иван", "Игорь", "Константин", "Максим", "Михаил", "Николай", "Олег", "Павел", "Пётр", "Роман", "Сергей", "Юрий"),
}
SURNAMES = {
    ("", "latin"): (("Al", "Ash", "Bar", "Beck", "Berg", "Black", "Brad", "Brand", "Burn", "Carl", "Clif", "Cold", "Dal", "Eder", "El", "Fair", "Fal", "Gar", "Glen", "Hal", "Hart", "Hof", "Holl", "Kel", "Lang", "Lind", "Mar", "Mil", "Nor", "Oak", "Pres", "Ram", "Rosen", "Sand", "Sher", "Stan", "Thorn", "Wal", "Wes", "Wil"), ("bach", "beck", "berg", "born", "by", "combe", "dale", "den", "dorf", "feld", "field", "ford", "gate", "ham", "hart", "ington", "land", "ley", "lin", "man", "mann", "more", "ridge", "sen", "ser", "son", "stad", "stein", "ston", "stone", "strom", "ton", "well", "wick", "win", "wood")),
    ("male", "cyrillic"): (("Бел", "Вол", "Гор", "Дан", "Жук", "Зим", "Кал", "Ким", "Кор", "Лаз", "Мал", "Ник", "Пав", "Рог", "Сав", "Сол", "Тар", "Фил", "Чер", "Шам"), ("анов", "арин", "еев", "елин", "енов", "ецов", "ивин", "иков", "илин", "инов", "ихов", "олов", "онин", "очкин", "уев", "ушин")),
    ("female", "cyrillic"): (("Бел", "Вол", "Гор", "Дан", "Жук", "Зим", "Кал", "Ким", "Кор", "Лаз", "Мал", "Ник", "Пав", "Рог", "Сав", "Сол", "Тар", "Фил", "Чер", "Шам"), ("анова", "арина", "еева", "елина", "енова", "ецова", "ивина", "икова", "илина", "инова", "ихова", "олова", "онина", "очкина", "уева", "ушина")),
}
#: Symbols that replace each other, in lower case.
ALPHABETS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûü", "ñçß", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщъь", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρσςτφχψ")
HEX_ALPHABETS = ("0123456789", "abcdef")
ROUNDS = 6
#: Draws after which addresses and names grow longer, after which other kinds keep a surrogate that is a real entity, and at which the job ends with an error.
WIDER_AFTER, FULL_AFTER, MOST_DRAWS = 3, 40, 64
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
NAME = r"\p{Lu}[\p{Ll}]+(?:-\p{Lu}\p{Ll}+)?"
#: A word of a script without capitals that puts spaces between words: after a title it is a name.
PLAIN_NAME = r"[\p{IsGeorgian}\p{Lo}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]][\p{L}\p{M}]{1,20}"
TITLED = f"(?:{NAME}|{PLAIN_NAME})"
TITLE = "|".join(t for titles in TITLES.values() for t in titles)
#: (type, pattern) in the order in which they are tried at a place.
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![0-9A-Za-z])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("ipv4", rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9])(?!\.[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}|\+[0-9]{8,15})(?![0-9])"),
    ("name", rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{TITLE})\.? {TITLED}(?: {TITLED})?|(?:{'|'.join(n for names in FIRST_NAMES.values() for n in names)}) {NAME})(?!\p{{L}})"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, its last one not doubled; a valid number's is divisible by 10."""
    places = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    worth = F.transform(places, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda s, x: s + x)


def mod_97(symbols: Column) -> Column:
    """The remainder of an account number whose letters count 10 to 35, as of a long decimal."""
    chars = F.filter(F.split(F.lower(symbols), ""), lambda c: c != "")
    value = lambda c: F.position(c, F.lit("abcdefghijklmnopqrstuvwxyz")) + 9
    return F.aggregate(chars, F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + value(c)) % 97).cast("int"))


def _symbols(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))


def kind_of(value: Column) -> Column:
    """The type whose pattern the whole value fits; the order of PATTERNS decides. Null for card and account numbers with a wrong check digit."""
    kind = F.coalesce(*[F.when(value.rlike(rf"\A(?:{p})\z"), F.lit(k)) for k, p in PATTERNS], F.lit("secret"))
    plain = _symbols(value)
    whole = F.when(kind == "card", luhn_sum(plain) % 10 == 0).when(kind == "iban", mod_97(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1).otherwise(True)
    return F.when(whole, kind)


def gender_of(name: Column) -> Column:
    """By the first name of a list, else by the title, else empty."""
    by_name = [F.when(name.rlike(rf"^(?:(?:{TITLE})\.? )?(?:{'|'.join(names)}) "), F.lit(g)) for (g, _), names in FIRST_NAMES.items()]
    by_title = [F.when(name.rlike(rf"^(?:{'|'.join(titles)})\.? "), F.lit(g)) for g, titles in TITLES.items() if g]
    return F.coalesce(*by_name, *by_title, F.lit(""))


def canonical(kind: Column, value: Column) -> Column:
    """What mentions of one entity have in common; a phone number's country code stays apart, since it is kept. A name is its gender, a bar and its words."""
    title = rf"^(?:{TITLE})\.? "
    abroad = r"^\+[0-9]{1,3}[ .(-]"
    prefixed = F.concat_ws("|", F.regexp_extract(value, r"^(\+[0-9]{1,3})", 1), F.regexp_replace(F.regexp_replace(value, r"^\+[0-9]{1,3}", ""), "[^0-9]", ""))
    name = F.concat(gender_of(value), F.lit("|"), F.regexp_replace(value, title, ""))
    return F.when(kind == "email", F.lower(value)).when((kind == "phone") & value.rlike(abroad), prefixed).when(kind == "ipv4", value).when(kind == "name", name).otherwise(_symbols(value))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _draw(digest: Column, at: Column) -> Column:
    return F.conv(F.substr(digest, (at * 4) % 60 + 1, F.lit(5)), 16, 10).cast("long")


@cache
def letter_runs() -> tuple[tuple[int, int], ...]:
    """(first, last) of runs of code points beyond ASCII: at least eight neighbouring letters in lower case or without case, or ten digits, of Unicode 3.2, which every runtime knows."""
    known, runs = unicodedata.ucd_3_2_0, []
    for cp in range(0x80, 0x10000):
        c = chr(cp)
        kind = known.category(c)
        letter = kind in ("Ll", "Lo") and c.lower() == c and len(c.upper()) == 1
        kind = "letter" if letter else kind
        if kind in ("letter", "Nd"):
            if runs and runs[-1][1] == cp - 1 and runs[-1][2] == kind:
                runs[-1][1] = cp
            else:
                runs.append([cp, cp, kind])
    return tuple((a, b) for a, b, _ in runs if b - a >= 7)


def _rotated(symbol: Column, by: Column) -> Column:
    """A letter or digit of no alphabet: another one of its run of code points, and where it has none an accented letter, or a digit. Marks stay."""
    starts, ends = (F.lit([r[k] for r in letter_runs()]) for k in (0, 1))
    accented = ALPHABETS[3]
    letter = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    pick = lambda cp, text: F.substr(F.lit(text), ((cp + by) % len(text) + 1).cast("int"), F.lit(1))

    def other(cp: Column) -> Column:
        def within(run: Column) -> Column:
            inside = letter(run["a"] + (cp - run["a"] + by) % (run["b"] - run["a"] + 1))
            return F.when(cp <= run["b"], inside).when(symbol.rlike(r"^\p{N}$"), pick(cp, ALPHABETS[0])).when(symbol.rlike(r"^\p{L}$"), pick(cp, accented)).otherwise(symbol)

        at = F.size(F.filter(starts, lambda s: s <= cp)) - 1
        return _let(at, lambda k: _let(F.struct(F.coalesce(F.get(starts, k), F.lit(0)).cast("long").alias("a"), F.coalesce(F.get(ends, k), F.lit(-1)).cast("long").alias("b")), within))

    return _let(F.ascii(symbol).cast("long"), other)


def _shifted(symbol: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    moved = [F.when(F.position(symbol, F.lit(a)) > 0, F.substr(F.lit(a), ((F.position(symbol, F.lit(a)) - 1 + by) % len(a) + 1).cast("int"), F.lit(1))) for a in alphabets]
    return F.coalesce(*moved, _rotated(symbol, by))


def permuted(symbols: Column, tweak: Column, alphabets: tuple[str, ...] = ALPHABETS) -> Column:
    """Feistel rounds over the even and the odd places of a lower-case string; one-to-one for a given tweak and shape."""
    letters = F.filter(F.split(symbols, ""), lambda c: c != "")

    def one_round(state: Column, r: Column) -> Column:
        other = F.array_join(F.filter(state, lambda c, i: i % 2 != r % 2), "")
        shape = F.size(state).cast("string")
        return _let(F.sha2(F.concat_ws("|", tweak, r.cast("string"), shape, other), 256), lambda digest: F.transform(state, lambda c, i: F.when(i % 2 == r % 2, _shifted(c, _draw(digest, i), alphabets)).otherwise(c)))

    return F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), letters, one_round), "")


def _permuted_ipv4(value: Column, tweak: Column) -> Column:
    """Octets for symbols; the first stays within 1 to 223 if it is."""
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("long"))

    def one_round(state: Column, r: Column) -> Column:
        other = F.array_join(F.filter(F.transform(state, lambda o: o.cast("string")), lambda c, i: i % 2 != r % 2), ".")
        return _let(
            F.sha2(F.concat_ws("|", tweak, r.cast("string"), other), 256),
            lambda digest: F.transform(state, lambda o, i: F.when(i % 2 != r % 2, o).when(i > 0, (o + _draw(digest, i)) % 256).when((o >= 1) & (o <= 223), (o - 1 + _draw(digest, i)) % 223 + 1).otherwise(o)),
        )

    return F.array_join(F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), octets, one_round), lambda o: o.cast("string")), ".")


def _pick(seed: Column, part: str, choices: tuple[str, ...]) -> Column:
    at = F.conv(F.substr(F.sha2(F.concat_ws("|", seed, F.lit(part)), 256), F.lit(1), F.lit(12)), 16, 10).cast("long") % len(choices)
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (at + 1).cast("int"))


def _drawn_name(canon: Column, key: str, attempt: Column) -> Column:
    """A name for gender|words, drawn by the key and the whole entity: as many words, first names of the gender and script.

    From the second draw on surnames are double, and from the fifth on the letters are
    permuted; after WIDER_AFTER draws a name grows by a letter a draw, so that there is always
    another name. Scripts without lists are permuted at once.
    """
    seed = F.concat_ws("|", F.lit(key), canon, attempt.cast("string"))
    gender, words = F.regexp_extract(canon, r"^([a-z]*)\|", 1), F.split(F.regexp_replace(canon, r"^[a-z]*\|", ""), " ")
    last = F.element_at(words, -1)
    script = F.when(last.rlike(r"^[\p{IsLatin}-]+$"), "latin").when(last.rlike(r"^[\p{IsCyrillic}-]+$"), "cyrillic").otherwise("")
    # Without a known gender the draw decides for one.
    drawn = F.when(gender != "", gender).otherwise(_pick(seed, "gender", ("female", "male")))
    firsts = [F.when((drawn == g) & (script == s), _pick(seed, "first", names)) for (g, s), names in FIRST_NAMES.items()]
    surname = lambda part: F.coalesce(*[F.when((script == s) & ((drawn == g) | F.lit(g == "")), F.concat(_pick(seed, f"{part} begin", begins), _pick(seed, f"{part} end", ends))) for (g, s), (begins, ends) in SURNAMES.items()])
    lasts = F.when(attempt == 0, surname("last")).otherwise(F.concat(surname("last"), F.lit("-"), surname("second")))
    listed = F.when(F.size(words) > 1, F.concat_ws(" ", F.coalesce(*firsts), lasts)).otherwise(lasts)
    tweak = F.concat_ws("|", F.lit(key), F.lit("name"), attempt.cast("string"))
    salad = F.array_join(F.transform(words, lambda w: written(w, permuted(F.lower(F.regexp_replace(w, r"[^\p{L}]", "")), tweak))), " ")
    more = F.when(attempt > WIDER_AFTER, permuted(F.repeat(F.lower(F.right(last, F.lit(1))), attempt - WIDER_AFTER), tweak)).otherwise("")
    return F.when((attempt > 4) | (script == ""), F.concat(salad, more)).otherwise(listed)


def _with_luhn(payload: Column) -> Column:
    """The digits with the check digit that makes them a valid card number."""
    return F.concat(payload, ((10 - luhn_sum(F.concat(payload, F.lit("0"))) % 10) % 10).cast("string"))


def _with_mod_97(country: Column, account: Column) -> Column:
    """An account number with the two check digits after its country."""
    return F.concat(country, F.lpad((98 - mod_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)


def surrogate(kind: Column, canon: Column, key: str, attempt: Column) -> Column:
    """The canonical surrogate of a canonical entity; of a name its new words."""
    tweak = F.concat_ws("|", F.lit(key), kind, attempt.cast("string"))
    local, domain = F.regexp_extract(canon, r"^(.*)@", 1), F.regexp_extract(canon, r"@(.*)\.[^.]*$", 1)
    top = F.regexp_extract(canon, r"(\.[^.]*)$", 1)

    def spaced(part: Column, tweak: Column) -> Column:
        return filled(part, permuted(F.regexp_replace(part, r"[^\p{L}\p{N}]", ""), tweak))

    more = F.when(attempt > WIDER_AFTER, permuted(F.repeat(F.lit("a"), attempt - WIDER_AFTER), F.concat(tweak, F.lit("|more")))).otherwise("")
    country = F.regexp_extract(canon, r"^(\+[0-9]+\|)", 1)
    rest = F.substr(canon, F.length(country) + 1)
    return (
        F.when(kind == "email", F.concat(spaced(local, F.concat(tweak, F.lit("|"), domain)), more, F.lit("@"), spaced(domain, F.concat(tweak, F.lit("|domain"))), top))
        .when(kind == "ipv4", _permuted_ipv4(canon, tweak))
        .when(kind == "name", _drawn_name(canon, key, attempt))
        .when(kind == "card", _with_luhn(permuted(F.substr(canon, F.lit(1), F.length(canon) - 1), tweak)))
        .when(kind == "iban", _with_mod_97(F.substr(canon, F.lit(1), F.lit(2)), permuted(F.substr(canon, F.lit(5)), F.concat_ws("|", tweak, F.substr(canon, F.lit(1), F.lit(2))))))
        .when((kind == "secret") & canon.rlike("^[0-9a-f]+$"), permuted(canon, tweak, HEX_ALPHABETS))
        .otherwise(F.concat(country, permuted(rest, tweak)))
    )


def filled(form: Column, symbols: Column) -> Column:
    """``form`` with its letters and digits replaced by ``symbols`` in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"), symbols.alias("left"))

    def step(acc: Column, c: Column) -> Column:
        is_symbol = c.rlike(r"^[\p{L}\p{N}]$")
        return F.struct(F.concat(acc["out"], F.when(is_symbol, F.substr(acc["left"], acc["next"], F.lit(1))).otherwise(c)).alias("out"), (acc["next"] + is_symbol.cast("int")).alias("next"), acc["left"].alias("left"))

    return F.aggregate(F.filter(F.split(form, ""), lambda c: c != ""), start, step)["out"]


def written(form: Column, symbols: Column) -> Column:
    """As ``filled``, with capitals where ``form`` has them."""

    def cased(plain: Column) -> Column:
        return F.transform(F.filter(F.split(form, ""), lambda c: c != ""), lambda c, i: F.when(c.rlike(r"^\p{Lu}$"), F.upper(F.substr(plain, i + 1, F.lit(1)))).otherwise(F.substr(plain, i + 1, F.lit(1))))

    return F.array_join(_let(filled(form, symbols), cased), "")


def render(kind: Column, raw: Column, canon: Column, new: Column) -> Column:
    """The surrogate in the format of one mention; of a name that is linked to a longer one, the word at the same end."""
    lead, words = F.regexp_extract(raw, rf"^((?:{TITLE})\.? )", 1), F.split(new, " ")
    name = F.when(F.contains(F.substr(raw, F.length(lead) + 1), F.lit(" ")), new).otherwise(F.element_at(words, -1))
    return F.when(kind == "name", F.concat(lead, name)).when((kind == "ipv4") | ((kind == "email") & (F.length(new) > F.length(raw))), new).otherwise(written(raw, F.regexp_replace(new, r"[^\p{L}\p{N}]", "")))


def _words_of(kind: Column, canon: Column) -> Column:
    """What a surrogate must not be: the entity as it is written."""
    return F.when(kind == "name", F.regexp_replace(canon, r"^[a-z]*\|", "")).otherwise(canon)


def settled_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, new) for distinct (kind, canon) whose first surrogate is a real entity of its kind, or one in use.

    Permuted surrogates are distinct from the start; of names that drew the same one the
    smallest keeps it. Those that clash are drawn again, tweak by tweak, until they meet
    neither an entity nor a surrogate. Addresses and names have room for that, as they grow
    longer in the end. Other kinds keep their form; if it is so full of real entities that
    FULL_AFTER draws met one each time, the first surrogate stays: permuted, so that no
    other entity has it, but one that is real too.
    """
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work a row
    drawn = staged(entities.repartition(tasks, "kind", "canon").select("kind", "canon", surrogate(F.col("kind"), F.col("canon"), key, F.lit(0)).alias("new")), "pii-drawn")
    real = drawn.select("kind", _words_of(F.col("kind"), F.col("canon")).alias("new")).distinct()

    def firsts(rows: DataFrame) -> DataFrame:
        own = (F.col("kind") == "name") & F.arrays_overlap(F.split("new", " "), F.split(_words_of(F.col("kind"), F.col("canon")), " "))
        return rows.filter(~own).groupBy("kind", "new").agg(F.min("canon").alias("canon"))

    good = staged(firsts(drawn).join(real, ["kind", "new"], "left_anti").select("kind", "canon", "new"), "pii-good")
    pending = staged(drawn.select("kind", "canon").join(good.select("kind", "canon"), ["kind", "canon"], "left_anti"), "pii-clashes")
    used, solved, attempt = good.select("kind", "new"), pending.limit(0).select("kind", "canon", F.lit("").alias("new")), 0
    while pending.count():
        attempt += 1
        again = pending.select("kind", "canon", surrogate(F.col("kind"), F.col("canon"), f"{key}|again", F.lit(attempt)).alias("new"))
        free = staged(firsts(again).join(real, ["kind", "new"], "left_anti").join(used, ["kind", "new"], "left_anti").select("kind", "canon", "new"), "pii-solved")
        solved, used = solved.unionByName(free), used.unionByName(free.select("kind", "new"))
        left = pending.join(free.select("kind", "canon"), ["kind", "canon"], "left_anti")
        if attempt >= FULL_AFTER:
            full = left.filter(~F.col("kind").isin("email", "name")).join(drawn, ["kind", "canon"]).filter("new <> canon").select("kind", "canon", "new")
            full = staged(full, "pii-full")
            solved, used = solved.unionByName(full), used.unionByName(full.select("kind", "new"))
            left = left.join(full.select("kind", "canon"), ["kind", "canon"], "left_anti")
        if attempt >= MOST_DRAWS:
            raise RuntimeError(f"{pending.count()} entities have no surrogate after {attempt} draws")
        pending = staged(left, "pii-pending")
    return solved


def _linked(found: Column) -> Column:
    """Mentions (raw, kind, canon) of a document, those of one name word linked to the first longer name that ends in it."""
    bare_name = lambda m: F.regexp_extract(m["canon"], r"\|(.*)$", 1)
    longer = lambda: F.filter(found, lambda m: (m["kind"] == "name") & F.contains(m["canon"], F.lit(" ")))

    def linked(m: Column) -> Column:
        whole = F.get(F.filter(longer(), lambda o: F.endswith(o["canon"], F.concat(F.lit(" "), bare_name(m)))), F.lit(0))["canon"]
        alone = (m["kind"] == "name") & ~F.contains(m["canon"], F.lit(" "))
        return F.struct(m["raw"].alias("raw"), m["kind"].alias("kind"), F.when(alone, F.coalesce(whole, m["canon"])).otherwise(m["canon"]).alias("canon"))

    return F.when(F.exists(found, lambda m: m["kind"] == "name"), F.transform(found, linked)).otherwise(found)


def mentions(docs: DataFrame, keys: list[str], raw_array: str = "found") -> DataFrame:
    """One row per detected mention: keys, idx, raw, kind, canon; what fits a pattern but fails its check digit has a null kind."""
    kinds = F.transform(raw_array, lambda r: F.struct(r.alias("raw"), kind_of(r).alias("kind")))
    known = docs.select(*keys, kinds.alias("ms"))
    named = known.select(*keys, F.transform("ms", lambda m: F.struct(m["raw"].alias("raw"), m["kind"].alias("kind"), F.when(m["kind"].isNotNull(), canonical(m["kind"], m["raw"])).alias("canon"))).alias("ms"))
    return named.select(*keys, _linked(F.col("ms")).alias("ms")).select(*keys, F.posexplode("ms").alias("idx", "m")).select(*keys, "idx", "m.*")


def _repeats(new: Column) -> Column:
    """Map of the words of a document's detected names to their surrogates; the first name that has a word decides."""
    named = F.filter(new, lambda m: m["kind"] == "name")

    def pairs(m: Column) -> Column:
        old, fresh = F.split(F.regexp_extract(m["canon"], r"\|(.*)$", 1), " "), F.split(m["first"], " ")
        return F.zip_with(old, fresh, lambda o, n: F.struct(o.alias("key"), n.alias("value")))

    flat = F.flatten(F.transform(named, pairs))
    words = F.array_distinct(F.transform(flat, lambda p: p["key"]))
    return F.map_from_arrays(words, F.transform(words, lambda w: F.element_at(F.filter(flat, lambda p: p["key"] == w), 1)["value"]))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text rewritten, and ``n_entities``, ``kinds`` and ``entities``.

    ``key`` is the secret that surrogates depend on. ``entities`` lists (kind, surrogate) in
    the order of the text. Words of a detected name that stand alone in its document follow
    that name; they are no entities of their own. A null text stays null and has none. Equal
    rows come back equal, as often as they came.
    """
    if not key:
        raise ValueError("a key is needed")
    text = bare(text_col)
    marked = staged(docs.select(packed(docs), bare(id_col).alias("id"), F.xxhash64(text).alias("h"), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({ANY})"), F.lit(1)).alias("found")), "pii-marked")
    hit = marked.filter(F.size("found") > 0)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = staged(mentions(hit.select("id", "h", "found").distinct().repartition(tasks, "id", "h"), ["id", "h"]), "pii-mentions")
    sure = found.filter("kind is not null")
    clashes = staged(settled_surrogates(sure.select("kind", "canon").distinct(), key), "pii-settled")
    n_clashes = clashes.count()
    first = sure.repartition(tasks, "id", "h").withColumn("first", surrogate(F.col("kind"), F.col("canon"), key, F.lit(0)))
    if n_clashes:
        first = first.join(F.broadcast(clashes) if n_clashes <= 100_000 else clashes, ["kind", "canon"], "left").withColumn("first", F.coalesce("new", "first"))
    named = first.select("id", "h", "idx", "kind", "canon", "first", render(F.col("kind"), F.col("raw"), F.col("canon"), F.col("first")).alias("out"))
    per_doc = named.groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("idx", "kind", "canon", "first", "out"))).alias("told"))
    at = F.map_from_arrays(F.transform("told", lambda m: m["idx"]), F.transform("told", lambda m: m["out"]))
    per_doc = staged(per_doc.select(F.col("id").alias("d_id"), F.col("h").alias("d_h"), F.transform("told", lambda m: F.struct(m["kind"].alias("kind"), m["out"].alias("surrogate"))).alias("new"), at.alias("at"), _repeats(F.col("told")).alias("words")), "pii-documents")
    joined = hit.join(per_doc, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("h") == F.col("d_h")))

    def repeated(piece: Column) -> Column:
        parts = F.split(piece, r"(?<=\p{L})(?!\p{L})|(?<!\p{L})(?=\p{L})", -1)
        return F.when(F.size("words") == 0, piece).otherwise(F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at("words", w), w)), ""))

    pieces = F.split(F.col(ROW)[text_col], ANY, -1)
    # What fits a pattern but is no entity keeps its place.
    rewritten = F.array_join(F.transform(pieces, lambda p, i: F.concat(repeated(p), F.coalesce(F.try_element_at("at", i), F.get("found", i), F.lit("")))), "")
    kind_list = "array<struct<kind:string,surrogate:string>>"
    changed = unpacked(joined, docs.columns, {text_col: rewritten, "n_entities": F.size("new").cast("long"), "kinds": F.array_join(F.array_sort(F.array_distinct(F.transform("new", lambda x: x["kind"]))), ","), "entities": F.col("new").cast(kind_list)})
    whole = marked.filter(F.size("found") == 0)
    same = lambda rows: unpacked(rows, docs.columns, {text_col: F.col(ROW)[text_col], "n_entities": F.lit(0).cast("long"), "kinds": F.lit(""), "entities": F.array().cast(kind_list)})
    none = hit.join(per_doc.select("d_id", "d_h"), F.col("id").eqNullSafe(F.col("d_id")) & (F.col("h") == F.col("d_h")), "left_anti")
    forget(found, clashes)
    return changed.unionByName(same(whole)).unionByName(same(none))
