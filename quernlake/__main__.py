import sys

from quernlake.cli import main

sys.exit(main())
