"""Column expressions shared by the text operators."""

from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"
#: The same set as characters.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def let(value, body):
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text):
    """Words of a text column; null and blank texts have none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def upto(n):
    """0 .. n-1, empty for n <= 0 (sequence() alone would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def before(values, fold):
    """For each element of an int array, ``fold`` (an aggregate of an array, 0 for an empty one) of what lies before it.

    In two levels, within pieces of about the root of the array's size and over the pieces, so an array of n costs
    n ** 1.5 at most. ``fold`` must be such that its value over several arrays is its value over their values.
    """

    def of(p):
        v, size = p["v"], p["c"]
        sums = F.transform(upto(F.ceil(F.size(v) / size).cast("int")), lambda j: fold(F.slice(v, j * size + 1, size)))
        bases = lambda s: F.transform(upto(F.size(s)), lambda j: fold(F.slice(s, F.lit(1), j)))
        each = lambda b: F.transform(upto(F.size(v)), lambda i: fold(F.array(F.get(b, (i / size).cast("int")), fold(F.slice(v, (i - i % size) + 1, i % size)))))
        return let(sums, lambda s: let(bases(s), each))

    return let(values, lambda v: let(F.struct(v.alias("v"), F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(v))).cast("int")).alias("c")), of))


def total(values):
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def most(values):
    return F.coalesce(F.array_max(values), F.lit(0))
