"""Query catalogue: importing this package registers every query."""

from . import catalogo, catalogo_cambios, catalogo_salidas  # noqa: F401
from .registro import ORACULO, REGISTRO  # noqa: F401
