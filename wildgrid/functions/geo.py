"""Place and season rules as column expressions."""

from pyspark.sql import functions as F

from .text import _col

# Season names, starting with the quarter that holds December.
SEASONS = ["Winter", "Spring", "Summer", "Autumn"]


def hemisphere(latitude):
    """1 north of the equator (equator included), else 0."""
    return (_col(latitude) >= 0).cast("int")


def season(month, north):
    """Season of a month: quarters start in December, the south is half a year off."""
    quarter = F.floor(F.pmod(_col(month), F.lit(12)) / 3)
    turn = F.when(_col(north) == 1, 0).otherwise(2)
    position = F.pmod(quarter + turn, F.lit(4)).cast("int")
    return F.get(F.array(*[F.lit(s) for s in SEASONS]), position)


def real_elevation(elevation, land):
    """Zero metres on land means unknown, hence null."""
    return F.when((_col(land) == 1) & (_col(elevation) == 0), None).otherwise(_col(elevation))


def grid_cell(latitude, longitude, per_degree=1):
    """The two integer coordinates of the grid cell that holds a point."""
    return (F.floor(_col(latitude) * per_degree).cast("int"),
            F.floor(_col(longitude) * per_degree).cast("int"))


def squared_distance(x, y):
    """Squared distance of two equally long lists of columns."""
    total = F.lit(0.0)
    for a, b in zip(x, y):
        total = total + (_col(a) - b) * (_col(a) - b)
    return total


def inside(edges, latitude, longitude):
    """Point in polygon by counting the edges that a ray towards east crosses.

    ``edges`` is an array of structs x1, y1, x2, y2. Only edges that span the
    point's latitude divide, and ``try_divide`` keeps level edges harmless.
    """
    lat, lon = _col(latitude), _col(longitude)

    def crosses(e):
        spans = (e.y1 > lat) != (e.y2 > lat)
        at = F.try_divide((e.x2 - e.x1) * (lat - e.y1), e.y2 - e.y1) + e.x1
        return spans & F.coalesce(lon < at, F.lit(False))

    return F.size(F.filter(edges, crosses)) % 2 == 1
