

from loomery.plans import registry as registry  # All queries are registered, in one order, whichever module is asked for first.
