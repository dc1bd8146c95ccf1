"""Functions in Java, compiled by the compiler that Spark itself carries and sent to the executors as a jar."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

HERE = os.path.dirname(os.path.abspath(__file__))


def available(spark: SparkSession) -> bool:
    """Sessions of Spark Connect have no JVM at hand."""
    return getattr(spark, "_jvm", None) is not None


def function(spark: SparkSession, source: str, name: str, returns: DataType) -> Callable[..., Column]:
    """The class ``statweave.{source}${name}`` of ``{source}.java``, a UDF, as a function of columns."""
    with open(f"{HERE}/{source}.java") as file:
        text = file.read()
    jar = f"statweave-{source}-{hashlib.sha256(text.encode()).hexdigest()[:16]}.jar"
    jvm, context = spark._jvm, spark.sparkContext
    if not any(str(x).endswith(jar) for x in context._jsc.sc().listJars().mkString("\n").split("\n")):
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(text)
        path = os.path.join(tempfile.mkdtemp(prefix="statweave-"), jar)
        with zipfile.ZipFile(path, "w") as out:
            for entry in compiler.getBytecodes().entrySet().toArray():
                out.writestr(entry.getKey().replace(".", "/") + ".class", bytes(entry.getValue()))
        spark.sql(f"ADD JAR '{path}'")
    loader = spark._jsparkSession.sharedState().jarClassLoader()
    made = jvm.java.lang.Class.forName(f"statweave.{source}${name}", True, loader).newInstance()
    registered = f"statweave_{source}_{name}".lower()
    spark._jsparkSession.udf().register(registered, made, spark._jsparkSession.parseDataType(returns.json()))
    return lambda *columns: F.call_function(registered, *columns)
