import sys

from .plans.run import main

sys.exit(main())
