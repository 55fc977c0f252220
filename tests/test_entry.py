import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_training_data_subpackage(tmp_path):
    """The rest imports, lists its queries and passes its tests when llm folders and corpus_pipeline.py are gone."""
    for name in ("quillspark", "tests"):
        shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    env = os.environ | {"PYTHONPATH": os.pathsep.join(x for x in (str(tmp_path), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if x != ROOT and x)}
    code = "import __spark_entry__ as e; q = e.queries(); assert 'vec_topk_cosine' in q and not any(n.startswith('op1') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    run = lambda *args: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *args], cwd=tmp_path, env=env, capture_output=True, text=True)
    listed = run("--collect-only", "tests")
    assert listed.returncode == 0 and "test_segment" in listed.stdout and "llm" not in listed.stdout, listed.stdout
    passed = run(*(f"tests/test_{x}.py" for x in ("segment", "evaluation", "sinks")))
    assert passed.returncode == 0, passed.stdout


def test_nothing_else_imports_the_subpackage():
    for top, _, names in os.walk(f"{ROOT}/quillspark"):
        if "llm" not in os.path.relpath(top, ROOT).split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    with open(f"{top}/{n}", encoding="utf-8") as f:
                        assert "quillspark.llm" not in f.read(), f"{top}/{n}"


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 500 * 10
