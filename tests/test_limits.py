import pytest

from arcspan.operators import poles
from arcspan.plans import registry
from arcspan.plans.runtime import checkpoint_ready


def test_two_site_poles_keeps_every_site(spark, small, monkeypatch):
    monkeypatch.setattr(poles, "MAX_POLES", 1)
    assert registry.queries()["two_site_poles"](spark, small).count() > 1


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():
            return Context

        @staticmethod
        def isDefined():
            return False

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError):
        checkpoint_ready(Session)
