"""Official housing prices and deposit guarantees as Spark table jobs.

Sub-packages:

* ``functions``  column expressions (keys, numbers, money, addresses, guarantee rule)
* ``operators``  DataFrame -> DataFrame building blocks (joins, aggregates, order statistics)
* ``sources``    readers, response decoders, sinks
* ``plans``      end-to-end jobs and the catalog of registered queries
* ``streaming``  file-source stream of lookup requests
"""
