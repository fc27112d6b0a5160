"""Spatial filters: a bounding-box prefilter on coordinate dimensions, then the exact predicate."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions import geometry as G
from gridlake.sources.table import ArrayTable

log = logging.getLogger(__name__)


def mbr(constant: bytes) -> tuple[float, float, float, float] | None:
    return G.envelope(G.from_wkb(constant))


def mbr_filter(cells: DataFrame, box: tuple[float, float, float, float], pad_x: float = 0.0, pad_y: float = 0.0, x: str = "_X", y: str = "_Y") -> DataFrame:
    """Cells whose centroid lies in the box, widened by half the padding on each side; reaches the scan's filters."""
    x0, y0, x1, y1 = box
    return cells.where(F.col(x).between(x0 - pad_x / 2, x1 + pad_x / 2) & F.col(y).between(y0 - pad_y / 2, y1 + pad_y / 2))


def spatial_filter(cells: DataFrame, area: bytes, predicate: str = "intersects", pad_x: float | None = None, pad_y: float | None = None, column: str = "wkb_geometry", x: str = "_X", y: str = "_Y", prefilter: bool = True) -> DataFrame:
    """Cells whose geometry intersects, overlaps or equals a constant one (WKB).

    The prefilter compares centroids, so it needs the greatest extent of the geometries as padding; without padding
    it is left out, since it could lose geometries that reach into the area.
    """
    if predicate not in G.PREDICATES:
        raise ValueError(f"unsupported predicate: {predicate}")
    box = mbr(area)
    if prefilter and box is not None:
        if pad_x is None or pad_y is None:
            log.warning("no padding is known: the exact predicate runs on every geometry")
        else:
            cells = mbr_filter(cells, box, 2 * pad_x, 2 * pad_y, x, y)
    return cells.where(G.st_predicate(F.col(column), area, predicate))


def find_geometries(table: ArrayTable, area: bytes, predicate: str = "intersects") -> DataFrame:
    """Cells of a spatial array whose geometry meets a constant one (WKB).

    The array's metadata names the geometry's attribute and the greatest extents of its geometries; the padded box goes
    into the slice of the two coordinate dimensions, so it prunes fragments and row groups.
    """
    about, dims = table.metadata_values(), table.schema.dims
    column = about.get("GEOMETRY_ATTRIBUTE_NAME", "wkb_geometry")
    box, pads = mbr(area), (about.get("PAD_X"), about.get("PAD_Y"))
    if box is None or None in pads:
        return spatial_filter(table.df(), area, predicate, column=column, prefilter=False)
    x0, y0, x1, y1 = box
    cells = table.slice({dims[0]: (x0 - pads[0], x1 + pads[0]), dims[1]: (y0 - pads[1], y1 + pads[1])})
    return spatial_filter(cells, area, predicate, column=column, prefilter=False)
