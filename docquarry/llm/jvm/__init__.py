"""Java kernels, compiled in the driver by the compiler that Spark carries and sent to executors as a jar."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def register(spark: SparkSession, name: str, function: str, returns: str) -> None:
    """Makes class ``name`` (name.java here, implementing a UDF interface) callable in SQL as ``function``."""
    key = f"docquarry.jar.{name}"
    if spark.conf.get(key, None) is not None:
        return
    with open(os.path.join(os.path.dirname(__file__), f"{name}.java")) as f:
        source = f.read()
    jvm = spark.sparkContext._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(source)
    codes = compiler.getBytecodes()
    fd, path = tempfile.mkstemp(suffix=".jar")  # the driver serves it to executors
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for c in codes.keySet():
            z.writestr(f"{c.replace('.', '/')}.class", bytes(codes[c]))
    spark.sql(f"ADD JAR '{path}'")
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    kernel = jvm.java.lang.Class.forName(name, True, loader).getDeclaredConstructor(spark.sparkContext._gateway.new_array(jvm.java.lang.Class, 0)).newInstance(spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 0))
    spark._jsparkSession.udf().register(function, kernel, jvm.org.apache.spark.sql.types.DataType.fromDDL(returns))
    spark.conf.set(key, path)
