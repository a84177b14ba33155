import sys

from fluxspan.cli import main

sys.exit(main())
