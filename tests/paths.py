"""Input folders of the tests; a module of its own, as each test folder has a conftest."""

SMALL = "/root/testdata/sf0.001"
