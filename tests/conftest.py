import pytest

from medwarden.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", partitions=4)
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collected rows as sorted tuples."""

    def collect(df, *columns):
        found = df.select(*columns).collect() if columns else df.collect()
        return sorted((tuple(r) for r in found), key=lambda r: tuple((v is None, str(v)) for v in r))

    return collect
