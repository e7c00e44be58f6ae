"""The small corpus that the scenarios share: one document of four paragraphs, seven entities, six relationships."""

from pyspark.sql import functions as F

from lodestone.schemas import ENTITIES, EVIDENCE, RELATIONSHIPS, Graph

PARAGRAPHS = [
    "FastAPI is a modern Python web framework.",
    "FastAPI uses Pydantic for data validation and Starlette for web functionality.",
    "Sebastián Ramírez created FastAPI.",
    "FastAPI is commonly used to build APIs and microservices.",
]
TEXT = "\n\n".join(PARAGRAPHS)
WORDS = ["fastapi", "python", "framework", "pydantic", "starlette", "validation", "sebastián", "ramírez", "created", "microservices", "web", "apis"]
NODES = [
    ("FastAPI", "Technology", ["Fast API", "fastapi"]), ("Python", "ProgrammingLanguage", []), ("Pydantic", "Technology", []), ("Starlette", "Technology", []),
    ("Sebastián Ramírez", "Person", []), ("API", "Concept", []), ("Microservices", "Concept", []),
]
LINKS = [
    ("FastAPI", "Python", "WRITTEN_IN", 0.95, 0), ("FastAPI", "Pydantic", "USES", 0.94, 1), ("FastAPI", "Starlette", "USES", 0.93, 1),
    ("Sebastián Ramírez", "FastAPI", "CREATED", 0.97, 2), ("FastAPI", "API", "PROVIDES", 0.85, 3), ("FastAPI", "Microservices", "PROVIDES", 0.85, 3),
]


def embed(text):
    return [float(text.lower().count(w)) for w in WORDS]


def graph(spark):
    nodes = spark.createDataFrame([(n, n, t, a, None, None, i) for i, (n, t, a) in enumerate(NODES)], ENTITIES)
    links = spark.createDataFrame([(f"r{i}", a, b, t, c, None, i) for i, (a, b, t, c, _) in enumerate(LINKS)], RELATIONSHIPS)
    proof = spark.createDataFrame([(f"v{i}", f"r{i}", f"c{k}", PARAGRAPHS[k], c, i) for i, (_, _, _, c, k) in enumerate(LINKS)], EVIDENCE)
    return Graph(nodes, links, proof)


def simple_graph(spark, n, edges):
    """Nodes "0" to n - 1; edges (source, target, type, confidence)."""
    nodes = spark.createDataFrame([(str(i), f"N{i}", "Concept", [], None, None, i) for i in range(n)], ENTITIES)
    links = spark.createDataFrame([(f"e{i}", str(a), str(b), t, c, None, i) for i, (a, b, t, c) in enumerate(edges)], RELATIONSHIPS)
    return Graph(nodes, links, spark.createDataFrame([], EVIDENCE))


def ids(df):
    return {r["id"] for r in df.select(F.col("id")).collect()}
