"""Every operator bound to the test tables, with the SQL that gives the same rows.

The tables hold no sports data, so each operator runs on columns of the same shape: order lines as
plays, orders as games, events as signal and scores, text as scoreboard tokens, vectors as boxes.
"""

from fieldglass.catalog import base  # noqa: F401
from fieldglass.catalog import plays, asof, games, tokens, signal, vision, records, models, live  # noqa: F401
from fieldglass.catalog.base import QUERIES, SQL  # noqa: F401
