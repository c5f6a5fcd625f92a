"""Command line: ``python -m galley <command> key=value ...``."""
import json
import sys

from pyspark.sql import SparkSession

from . import api


def main(arguments: list[str]) -> int:
    if not arguments or arguments[0] in ("-h", "--help"):
        print("\n".join(f"{name:18} {what}" for name, (_, what) in api.COMMANDS.items()))
        return api.EXIT["ok"] if arguments else api.EXIT["usage"]
    spark = SparkSession.builder.getOrCreate()
    try:
        for row in api.run(spark, arguments[0], **dict(x.split("=", 1) for x in arguments[1:])).toJSON().toLocalIterator():
            print(row)
    except (api.CommandError, ValueError) as e:
        known = e.to_dict() if isinstance(e, api.CommandError) else {"ok": False, "code": "usage", "message": str(e), "details": {}}
        print(json.dumps(known, ensure_ascii=False))
        return api.EXIT["usage"]
    return api.EXIT["ok"]


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
