import os
import sys

import pytest

RAIZ = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, RAIZ)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from matricula.sesion import crear_sesion

    s = crear_sesion("local[4]", particiones=4, memoria="4g")
    yield s
    s.stop()
