"""Native column functions over keys, flags, paths and formulas. Nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format: locale bits, the content bits that are defined, the codes that name a locale.
LOCALES = {
    "enUS": 0x2, "koKR": 0x4, "frFR": 0x10, "deDE": 0x20, "zhCN": 0x40, "esES": 0x80, "zhTW": 0x100, "enGB": 0x200,
    "enCN": 0x400, "enTW": 0x800, "esMX": 0x1000, "ruRU": 0x2000, "ptBR": 0x4000, "itIT": 0x8000, "ptPT": 0x10000,
}
LOCALE_ALL = 0xFFFFFFFF
#: All but the two Chinese-run English realms.
LOCALE_RETAIL = sum(v for k, v in LOCALES.items() if k not in ("enCN", "enTW"))
CONTENT_BITS = {"high_res_texture": 0x1, "windows": 0x8, "macos": 0x10, "alternate": 0x80, "encrypted": 0x08000000, "no_name_hash": 0x10000000, "not_compressed": 0x80000000}
CONTENT_KNOWN = sum(CONTENT_BITS.values())
LOCALE_CODES = {k.lower(): v for k, v in LOCALES.items() if k not in ("enCN", "enTW")}

# Prefixes of product ids in the order in which they are tried, the games, their data folders and short names.
GAME_PREFIXES = (
    ("hero", "HeroesOfTheStorm"), ("hs", "Hearthstone"), ("w3", "Warcraft3Reforged"), ("s1", "StarCraft"), ("sc1", "StarCraft"),
    ("s2", "StarCraft2"), ("wow", "WorldOfWarcraft"), ("d3", "DiabloIII"), ("diablo3", "DiabloIII"), ("agent", "Agent"),
    ("pro", "Overwatch"), ("bna", "BattleNet"), ("clnt", "Client"), ("dst2", "Destiny2"), ("osi", "DiabloIIResurrected"),
    ("wlby", "Wlby"), ("viper", "Viper"), ("odin", "Odin"), ("lazr", "Lazarus"), ("fore", "Fore"), ("zeus", "Zeus"),
    ("rtro", "Rtro"), ("anbs", "Anbs"), ("fenris", "DiabloIV"), ("drtl2", "DiabloRTL2"), ("drtl", "DiabloRTL"),
    ("war1", "Warcraft"), ("w2bn", "Warcraft2"), ("gryphon", "Gryphon"),
)
DATA_FOLDERS = {
    "HeroesOfTheStorm": "HeroesData", "StarCraft": "Data", "StarCraft2": "SC2Data", "Hearthstone": "Hearthstone_Data",
    "WorldOfWarcraft": "Data", "DiabloIII": "Data", "DiabloIV": "Data", "Warcraft3Reforged": "Data",
    "DiabloIIResurrected": "Data", "Odin": "Data", "Overwatch": "data/casc",
}
SHORT_NAMES = {
    "DiabloIIResurrected": "D2R", "DiabloIV": "D4", "DiabloIVBeta": "D4 Beta", "DiabloIII": "D3", "WorldOfWarcraft": "WoW",
    "Warcraft3Reforged": "WC3", "StarCraft": "SC1", "StarCraft2": "SC2", "HeroesOfTheStorm": "HotS", "Hearthstone": "HS",
    "Overwatch": "OW2",
}


def mapped(value: Column, table: dict, default: Column | None = None) -> Column:
    """table[value] as a chain of conditions, for small fixed tables."""
    found = reduce(lambda c, kv: c.when(value == F.lit(kv[0]), F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit(next(iter(table.values())))))
    return found if default is None else found.otherwise(default)


# Keys.


def hash_hex(h: Column) -> Column:
    """A 64-bit hash as 16 upper-case digits."""
    return F.lpad(F.hex(h), 16, "0")


def key_from_hex(text: Column, digits: int = 32) -> Column:
    """The bytes of exactly `digits` hex digits in either case, else null."""
    return F.when(F.length(text) == digits, F.try_to_binary(text, F.lit("hex")))


def key9(key: Column) -> Column:
    """The nine bytes that indices know a key by."""
    return F.substring(key, 1, 9)


def same_key9(a: Column, b: Column) -> Column:
    return key9(a) == key9(b)


def is_zero_key(key: Column) -> Column:
    return F.ltrim(F.hex(key), F.lit("0")) == ""


# Integers in bytes and bits.


def be_uint(data: Column, start: int | Column, width: int) -> Column:
    """The unsigned big-endian integer of width bytes (0 to 8) from start (1-based); 8 bytes keep their bits as signed."""
    if width == 0:
        return F.lit(0).cast("bigint")
    part = F.hex(F.substring(data, start, width) if isinstance(start, int) else F.substring(data, start, F.lit(width)))
    return F.conv(part, 16, -10 if width == 8 else 10).cast("bigint")


def le_uint(data: Column, start: int, width: int) -> Column:
    return be_uint(F.concat(*[F.substring(data, start + k, 1) for k in reversed(range(width))]), 1, width)


def bits(value: Column, start: int, count: int) -> Column:
    """count bits of value from bit start, unsigned; no bits are 0, 64 are all."""
    if count <= 0:
        return F.lit(0).cast("bigint")
    shifted = F.shiftrightunsigned(value, start)
    return shifted if count >= 64 else shifted.bitwiseAND((1 << count) - 1)


def unpack_location(high: Column, low: Column) -> tuple[Column, Column]:
    """(archive, offset) of a local index record's one high byte and four low bytes."""
    return F.shiftleft(high, 2).bitwiseOR(F.shiftrightunsigned(low, 30)), low.bitwiseAND(0x3FFFFFFF)


def fdid_hash(fdid: Column) -> Column:
    """The 64-bit FNV-1a-like hash of a file data id's four little-endian bytes, its multiply made of 32-bit limbs.

    h * (2 ** 32 + 0x1b3) modulo 2 ** 64, kept as two halves so that no product leaves the range of a signed long.
    """
    high, low = F.lit(0xCBF29CE4).cast("bigint"), F.lit(0x84222325).cast("bigint")
    mask = 0xFFFFFFFF
    for k in range(4):
        low = low.bitwiseXOR(F.shiftright(fdid.cast("bigint"), 8 * k).bitwiseAND(0xFF))
        product = low * 0x1B3
        high, low = (high * 0x1B3 + F.shiftright(product, 32) + low).bitwiseAND(mask), product.bitwiseAND(mask)
    return F.shiftleft(high, 32).bitwiseOR(low)


# Flags.


def locale_matches(locale: Column, mask: int) -> Column:
    return locale.bitwiseAND(mask) != 0


def known_content(content: Column) -> Column:
    """Content flags without the bits that aren't defined."""
    return content.bitwiseAND(CONTENT_KNOWN)


def parse_locale(text: Column) -> Column:
    """Codes parted by commas, bars or white space, as a mask; unknown ones are passed over, `all` or none gives all."""
    tokens = F.split(F.lower(text), r"[,|\s]+")
    codes = F.create_map(*[F.lit(x) for kv in LOCALE_CODES.items() for x in kv])
    mask = F.aggregate(tokens, F.lit(0).cast("bigint"), lambda acc, t: acc.bitwiseOR(F.coalesce(F.try_element_at(codes, t).cast("bigint"), F.lit(0).cast("bigint"))))
    return F.when(F.array_contains(tokens, "all") | (mask == 0), F.lit(LOCALE_ALL)).otherwise(mask)


def package_locale(path: Column) -> Column:
    """The mask of the four letters before a package suffix, else all."""
    low, out = F.lower(path), F.lit(LOCALE_ALL)
    # fixed values: the suffixes, tried in this order
    for suffix in reversed((".sc2data", ".sc2assets", ".stormdata", ".stormassets")):
        at = F.instr(low, suffix)
        code = mapped(F.substring(low, at - 4, F.lit(4)), LOCALE_CODES)
        out = F.when((at >= 5) & code.isNotNull(), code.cast("bigint")).otherwise(out)
    return out


# Products.


def game_type(uid: Column) -> Column:
    """The game of a product id by the first prefix that fits, else null."""
    return F.coalesce(*[F.when(uid.startswith(p), F.lit(g)) for p, g in GAME_PREFIXES])


def data_folder(game: Column) -> Column:
    return mapped(game, DATA_FOLDERS)


def display_name(game: Column, product: Column) -> Column:
    return mapped(game, SHORT_NAMES, F.upper(product))


def launcher(path: Column) -> Column:
    return F.when(path.contains("steamapps") | path.contains("Steam"), "Steam").otherwise("Battle.net")


# Paths.


def norm_parts(path: Column) -> Column:
    """Lower-cased components on either slash, empty ones dropped."""
    return F.filter(F.split(F.lower(path), r"[/\\]"), lambda x: x != "")


def parts(path: Column) -> Column:
    return F.filter(F.split(path, r"[/\\]"), lambda x: x != "")


def file_name(path: Column) -> Column:
    """What follows the last slash; back slashes are kept."""
    return F.element_at(F.split(path, "/"), -1)


def base_name(path: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def file_class(name: Column) -> Column:
    """image, model, data, audio, video or other, by extension."""
    low = F.lower(name)
    kinds = {"image": r"\.(blp|tex)$", "model": r"\.(m2|mdx)$", "data": r"\.(pow|gam)$", "audio": r"\.(mp3|ogg|wav|wsb)$", "video": r"\.vid$"}
    return F.coalesce(*[F.when(low.rlike(p), F.lit(k)) for k, p in kinds.items()], F.lit("other"))


def data_file(archive: Column) -> Column:
    return F.format_string("data.%03d", archive)


def remote_path(key: Column) -> Column:
    """aa/bb/<key>, lower-case."""
    h = F.lower(F.hex(key))
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), h)


def group_file(root: Column, index: Column) -> Column:
    """The path of a model's group file: stem_NNN and the extension; null without one."""
    return F.when(F.lower(root).endswith(".wmo"), F.format_string("%s_%03d.wmo", F.regexp_extract(root, r"(?is)^(.*)\.wmo$", 1), index))


def name_candidates(raw: Column) -> Column:
    """Names to try in order: the whole, without `data:`, what follows the last slash; empty ones and repeats dropped."""
    stripped = F.regexp_replace(raw, "^data:", "")
    return F.array_distinct(F.filter(F.array(raw, stripped, file_name(raw)), lambda n: n != ""))


# Sizes and dumps.


def size_text(n: Column) -> Column:
    # parts of a power of two are exact, so ties are real and go to the even digit
    kib, mib = F.bround(n / 1024.0, 1), F.bround(n / 1048576.0, 2)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KiB", kib)).otherwise(F.format_string("%.2f MiB", mib))


def hex_dump(data: Column, most: int = 256, width: int = 16) -> Column:
    """The first bytes in rows: offset, then digits in pairs."""
    part = F.substring(data, 1, most)
    row = lambda at: F.concat(
        F.lower(F.lpad(F.hex(at), 8, "0")), F.lit("  "), F.rtrim(F.regexp_replace(F.hex(F.substring(part, at + 1, F.lit(width))), "(..)", "$1 "))
    )
    return F.when(F.octet_length(part) > 0, F.transform(F.sequence(F.lit(0), F.octet_length(part) - 1, F.lit(width)), row)).otherwise(F.array().cast("array<string>"))


# Formulas.


def search_class(formula: Column) -> Column:
    """What content search calls a formula: by the table that it reads."""
    return F.when(formula.contains("Table(34,"), "damage formula").when(formula.contains("Table(35,"), "cooldown formula").otherwise("formula")


def formula_class(formula: Column) -> Column:
    """The preview's nine classes, the first that fits."""
    low = F.lower(formula)
    scaled = low.contains("table(") & low.contains("*")
    return (
        F.when(scaled & ~low.contains("table(34") & low.contains("table(35"), "cooldown_scalar")
        .when(scaled, "damage_scalar")
        .when(low.contains("attacks_per_second"), "attack_speed")
        .when(low.contains("affix") & low.contains("static value"), "unique_item_affix")
        .when(low.contains("affix_value"), "affix_modifier")
        .when(low.rlike(r"aoe_size|min\(|max\("), "aoe_scaling")
        .when(low.contains("chance_for_double_damage"), "crit_modifier")
        .when(formula.contains("SF_"), "sf_expression")
        .otherwise("expression")
    )


def coefficient(formula: Column) -> tuple[Column, Column]:
    """(number before the first `* Table(`, that table's number); null where there is none."""
    at = F.instr(formula, "* Table(")
    before = F.regexp_extract(F.trim(F.substring(formula, F.lit(1), at - 1)), r"([0-9.\-]+)$", 1)
    table = F.regexp_extract(F.substring(formula, at + 8, F.length(formula)), r"^([0-9]+)(?:,|$)", 1)
    real = lambda c, kind: F.when(at > 0, F.expr("null").cast(kind) if c is None else F.when(c != "", c.try_cast(kind)))
    return real(before, "double"), real(table, "bigint")


def sf_references(formula: Column) -> Column:
    """Distinct SF_<digits> in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(formula, F.lit("SF_[0-9]*"), F.lit(0)))


def sf_display(formula: Column) -> Column:
    """A formula's text; fractions under ten also as per cent."""
    v = formula.try_cast("double")
    return (
        F.when(formula == "", "(empty)")
        .when(v.isNull(), formula)
        .when(v == 0, "0")
        .when((F.abs(v) < 10) & (v != F.rint(v)), F.concat(v.cast("string"), F.lit("  ("), F.format_string("%.1f", v * 100), F.lit("%)")))
        .when(v == F.rint(v), F.format_string("%.0f", v))
        .otherwise(v.cast("string"))
    )
