"""Named plans over the test tables: each ``queries()`` key of the driver
contract is one function here, with its SQL twin in ``oracle``."""
