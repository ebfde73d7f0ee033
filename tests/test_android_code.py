"""Calls, line rules and rule files of Android projects."""

from pyspark.sql import functions as F

from veritrail.operators import android_code as C


def test_split_arguments(spark):
    cases = {'a, "b, c", f(d, [e, g])': ["a", '"b, c"', "f(d, [e, g])"], "": [], 'x, "q\\", y", z': ["x", '"q\\", y"', "z"], "{a: 1, b}, 'c,'": ["{a: 1, b}", "'c,'"]}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.a for r in df.select("x", C.split_arguments(F.col("x")).alias("a")).collect()} == cases


def test_code_rules(spark):
    code = 'Log.d(TAG, "token $userPassword")\nif (BuildConfig.DEBUG) Log.d("t", password)\nLog.e("t", "failed", e)\nLog.i("t", "plain text")\nsettings.javaScriptEnabled = true\n// setAllowFileAccess(true)\nhandler.proceed()'
    files = spark.createDataFrame([("A.kt", code, len(code))], "path string, content string, size_bytes int")
    calls = C.log_calls(files, {"password": "credential"}).orderBy("line").collect()
    assert [(r.sensitivity, r.debug_guarded, r.logs_exception) for r in calls] == [("credential", False, False), ("credential", True, False), (None, False, True), (None, False, False)]
    assert {(r.line, r.rule) for r in C.line_rules(files).collect()} == {(5, "webview-javascript"), (7, "webview-ssl-ignored")}


def test_rule_files(spark):
    raw = lambda t: spark.createDataFrame([("f", t)], "path string, raw string")
    xml = '<paths><root-path name="r" path="/"/><files-path name="f" path="images/"/><cache-path name="c" path="."/></paths>'
    assert {(r.element, r.severity) for r in C.provider_paths(raw(xml)).collect()} == {("root-path", "blocker"), ("cache-path", "minor")}
    rules = "match /a { allow read: if true; }\nmatch /b { allow read, write; }\nmatch /c { allow read: if request.auth != null; } // allow write: if true;"
    assert {(r.access, r.severity) for r in C.database_rules(raw(rules)).collect()} == {("read", "major"), ("read, write", "blocker")}
    assert [(r.access, r.severity) for r in C.database_rules(raw('{"rules": {".read": true, ".write": "auth != null"}}')).collect()] == [("read", "major")]
    g = C.google_services(raw('{"project_info": {"project_id": "p"}, "client": [{"client_info": {"android_client_info": {"package_name": "a.b"}}, "api_key": [{"current_key": "K"}]}]}')).first()
    assert (g.project_id, g.package_name, g.api_key_fingerprint[:7]) == ("p", "a.b", "sha256:")
