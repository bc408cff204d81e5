"""Operators for building training data from web text.

Ten operators (``html``, ``substring``, ``quality``, ``suffix``, ``decontam``, ``langid``,
``warc``, ``licences``, ``simhash``, ``bpe``) and the queries that apply them
(``catalogo.REGISTRO`` / ``catalogo.ORACULO``). Nothing else in the library imports this package.

Common rules, unless an operator's docstring says otherwise: a null text counts as an empty
text; every row of the input is read; input columns other than the named ones are ignored, so
extra columns cannot clash; an empty input gives an empty result with the full schema.
"""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
